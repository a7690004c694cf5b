import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text); extra=True adds columns whose names the operators use themselves."""

    def docs(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
        if extra:
            for c in ("score", "kept", "n_words", "_t", "_row", "fp", "tile", "node", "component", "n", "ids", "digest", "copies", "rate", "tokens", "held_out", "pii_email", "bucket", "_words", "start", "pid"):
                df = df.selectExpr("*", f"'clash' as `{c}`")
        return df

    return docs


@pytest.fixture(scope="session")
def awkward():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    prose = "the quick brown fox jumps over the lazy dog while seven wise old owls watch from a tall tree near the river bank today"
    return [
        (1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "ONE  Two"), (None, prose), (None, None), (8, "1 2 3 4"), (9, " ".join(f"w{i}" for i in range(30000))), (10, "x" * 200000),
        (11, "é ß …   　 名前 \U0001f600"), (12, prose + " mail me at some.one@mail.example.com or +1 (171) 555-2028 now"), (-5, prose.upper()),
    ]
