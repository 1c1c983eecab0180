"""The whole pipeline on the smallest tables, against plain versions of its stages."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest
from test_llm_mixing import brute_targets
from test_llm_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import toxicity
from tidewater.llm.common import WORD, documents, vocabulary
from tidewater.llm.mixing import Mix
from tidewater.llm.queries import TOXIC_AT, toxicity_model

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_pipeline(spark):
    import re

    docs = documents(spark, FOLDER)
    rows = {r["doc_id"]: r for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity_model(spark, docs, FOLDER))
    clean = {k for k, r in rows.items() if scorer.score(r["text"] or "")[0] < TOXIC_AT}
    assert len(clean) < len(rows)
    last = {}
    for k in sorted(clean):
        last[rows[k]["text"] or ""] = k
    single = sorted(last.values())
    assert len(single) < len(clean)
    classes = brute_components([(k, brute_fingerprint(rows[k]["text"], 3)) for k in single], 2)
    kept = {k for k, _, root in classes if k == root}

    stage_rows = []
    current = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        current = spark.createDataFrame(stage(spark, current, FOLDER).collect(), docs.schema)
        assert current.columns == docs.columns, name
        stage_rows.append(Counter(r["doc_id"] for r in current.collect()))
    assert stage_rows[0] == Counter(clean)
    assert stage_rows[1] == Counter(single)
    assert stage_rows[2] == Counter(kept)
    size = {k: len(re.findall(WORD, rows[k]["text"] or "")) for k in kept}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in kept:
        sizes[rows[k]["source"]] += size[k]
        taken[rows[k]["source"]] += size[k] * stage_rows[3][k]
        largest[rows[k]["source"]] = max(largest[rows[k]["source"]], size[k])
        assert stage_rows[3][k] <= 2
    for source, target in brute_targets(sizes, Mix()).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1

    library = Tokenizer.from_file(vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter()
    for k, n in stage_rows[3].items():
        ids = library.encode(rows[k]["text"] or "", add_special_tokens=False).ids
        expected[k, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += n
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == expected


def test_stages_on_an_empty_table(spark):
    docs = documents(spark, FOLDER)
    nothing = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0


def test_stages_on_odd_rows(odd, spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, FOLDER)
        assert out.count() > 0
        if name != "bpe":
            assert out.columns == odd.columns
