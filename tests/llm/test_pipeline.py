from __future__ import annotations

import hashlib
import importlib.util
import re
import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import tiktoken

from lexitab.llm import _support, bpe
from lexitab.llm.queries import QUERIES, VOCABULARY
from tests.llm.test_simhash import classes_of


def shingles(text: str | None) -> set[tuple[str, ...]]:
    """The five-word shingles of a text, or all its words where there are fewer."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a: set, b: set) -> bool:
    return len(a & b) >= 0.8 * len(a | b)


def test_stages(spark, small, tmp_path):
    documents = docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(i)))
        docs = found[name] = spark.read.parquet(str(tmp_path / str(i)))
    columns = documents.columns
    assert [n for n in found] == ["language_id", "simhash_dedup", "substring_dedup", "source_mixing", "byte_bpe"]
    assert all(found[n].columns == columns for n in list(found)[:-1])
    assert found["language_id"].exceptAll(documents).count() == 0 and found["language_id"].count() == documents.count()
    whole = {r["doc_id"]: shingles(r["text"]) for r in found["language_id"].collect()}
    alike = [(a, b) for a in whole for b in whole if a < b and similar(whole[a], whole[b])]
    assert sorted(r["doc_id"] for r in found["simhash_dedup"].collect()) == sorted(set(classes_of(sorted(whole), alike).values()))
    assert found["substring_dedup"].count() == found["simhash_dedup"].count()
    assert found["substring_dedup"].where("n_chars <> length(text)").count() == 0
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(VOCABULARY).ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in found["source_mixing"].collect()}
    last = found["byte_bpe"].collect()
    assert len(last) == found["source_mixing"].count()
    assert all(r["ids"] == encoding.encode_ordinary(texts[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in last)


def test_rejected_documents_go(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    strange = spark.createDataFrame([(10**9, "漢字" * 50, "xx", "s", 100), (10**9 + 1, None, None, None, None), (10**9 + 2, "12 34", "en", "s", 5)], documents.schema)
    out = corpus_pipeline.language_id(spark, documents.union(strange), small)
    assert out.where("doc_id >= 1000000000 and lang <> 'xx' or doc_id = 1000000001").count() == 0 and out.count() >= documents.count()


def test_empty_documents_pass_all_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_run_and_registry(spark, small):
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    folder = Path(_support.checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("*/*"))
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0
    new = set(folder.glob("*/*")) - before
    assert [p.parent.name for p in new] == ["pipeline"]  # the folder of the result, and nothing else


def test_entry_without_this_subpackage(tmp_path):
    """The library's own queries register where neither the subpackage nor the pipeline is there."""
    import shutil
    import subprocess

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "lexitab", tmp_path / "lexitab", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import re, __spark_entry__ as e; print(len(e.queries()), any(re.match('op[0-9]|pipeline', k) for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 80 and said.stdout.split()[1] == "False"
    assert importlib.util.find_spec("lexitab.llm")
