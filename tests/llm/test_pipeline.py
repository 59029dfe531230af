import re

import corpus_pipeline
import pytest
from test_dedup import brute
from tokenizers import Tokenizer

from notesearch.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, out[-1], "/root/testdata/sf0.001").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    for df in steps[1:5]:
        assert df.columns == steps[0].columns


def test_each_stage_against_brute_force(steps):
    raw, spoken, single, apart, mixed, encoded = (df.toPandas() for df in steps)
    assert set(spoken.doc_id) == {i for i, t in zip(raw.doc_id, raw.text) if any(c.isalpha() for c in t or "")}
    first = {}
    for i, t in sorted(zip(spoken.doc_id, spoken.text)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert set(single.doc_id) == set(first.values())
    groups = brute(list(zip(single.doc_id, single.text)), 80)
    assert set(apart.doc_id) == {i for i, (_, _, kept) in groups.items() if kept}
    words = lambda df: df.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).groupby(df.source).sum()
    before, after = words(apart), words(mixed)
    assert abs(after.sum() - 1.5 * before.sum()) < 0.35 * before.sum()
    assert set(mixed.doc_id) <= set(apart.doc_id) and mixed.groupby("doc_id").size().max() <= 2
    library = Tokenizer.from_file(tokenizer_path())
    text = dict(zip(apart.doc_id, apart.text))
    assert len(encoded) == len(mixed)
    for i, ids in zip(encoded.doc_id, encoded.ids):
        assert list(ids) == library.encode(text[i], add_special_tokens=False).ids
