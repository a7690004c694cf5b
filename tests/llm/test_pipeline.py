"""The pipeline, stage by stage and as a whole, against plain versions."""

from collections import Counter

import pytest

import corpus_pipeline
from tallyframe.llm import mixing, pii
from tallyframe.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_pair_join import other_brute
    from test_quality_rules import plain
    from test_tokens import check_pieces

    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard", "pseudonyms", "mixing", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    want = {i: r.text for i, r in rows.items() if plain(r.text)[-1]}
    kept = written(corpus_pipeline.STAGES[0][1](spark, docs, SF), "t")
    assert kept.columns == columns and {r.doc_id: r.text for r in kept.collect()} == want
    one_of = other_brute(list(want.items()), 5, 80)  # the stage's five words and 0.8
    want = {i: t for i, t in want.items() if one_of[i][1] == i}
    one = written(corpus_pipeline.STAGES[1][1](spark, kept, SF), "t")
    assert one.columns == columns and {r.doc_id: r.text for r in one.collect()} == want
    swap = pii.Pseudonyms(pii.session_key(spark))
    want = {i: swap.replace(t)[0] for i, t in want.items()}
    hidden = written(corpus_pipeline.STAGES[2][1](spark, one, SF), "t")
    assert hidden.columns == columns and {r.doc_id: r.text for r in hidden.collect()} == want
    mixed = written(corpus_pipeline.STAGES[3][1](spark, hidden, SF), "t")
    got = mixed.collect()
    assert mixed.columns == columns and all(r.text == want[r.doc_id] for r in got) and len({r.doc_id for r in got}) > 0.95 * len(want)
    # As many copies as the fitted rates say, which test_mixing holds against a plain fit.
    plan = {r.doc_id: r.copies for r in mixing.rates(hidden, table(spark, SF, "labels")).collect()}
    assert plan.keys() == want.keys() and Counter(r.doc_id for r in got) == Counter({i: n for i, n in plan.items() if n})
    distinct = mixed.dropDuplicates(["doc_id"])
    check_pieces([(r.doc_id, r.text) for r in distinct.collect()], corpus_pipeline.STAGES[4][1](spark, distinct, SF).collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    assert {r.sequence_id for r in rows} == set(range(max(r.sequence_id for r in rows) + 1)) and sum(r.length for r in rows) > 2048


def test_near_copies_of_five_words(spark, make):
    """Against a brute force on five words and 0.8; one changed word in 45 to 49 lies below 0.85 on four words."""
    import random

    from test_pair_join import brute, other_brute

    rng, rows = random.Random(9), []
    for i in range(40):
        w = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(44, 60))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:20] + ["changed"] + w[21:]))]
    want = sorted(i for i, (_, c) in other_brute(rows, 5, 80).items() if i == c)
    assert 40 < len(want) < len([i for i, (_, c) in brute(rows).items() if i == c])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, make(rows), SF).collect()) == want


@pytest.mark.parametrize("k", range(5))
def test_awkward(spark, make, awkward, k):
    name, stage = corpus_pipeline.STAGES[k]
    for rows in (awkward, []):
        df = make(rows, extra=True)
        got = stage(spark, df, SF)
        out = got.collect()
        assert k == 4 or got.columns == df.columns
        ids, texts = Counter(str(r.doc_id) for r in out), [t for _, t in rows]
        every = Counter(str(i) for i, _ in rows)
        if name == "quality_rules":
            from test_quality_rules import plain

            assert ids == Counter(str(i) for i, t in rows if plain(t)[-1])
        elif name == "ngram_jaccard":  # rows without an id stay, and one row of an id; equal texts have one row
            assert ids["None"] == every["None"] and all(n == 1 for i, n in ids.items() if i != "None")
            assert not rows or {"-5", "3", "4", "5"} <= ids.keys() and not {"1", "2"} & ids.keys()
        elif name == "pseudonyms":
            assert ids == every and sum(r.text is None for r in out) == texts.count(None) and not any("some.one@" in (r.text or "") for r in out)
        elif name == "mixing":
            assert ids.keys() <= every.keys() and {r.text for r in out} <= set(texts) and bool(out) == bool(rows)
        else:
            assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0) and sum(r.start == 0 for r in out) == len(rows)


def test_entry_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/tallyframe", tmp_path / "tallyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert 'rank_models' in q and not any(re.match('op[0-9]+_', x) or x == 'pipeline' for x in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, timeout=100).returncode == 0
