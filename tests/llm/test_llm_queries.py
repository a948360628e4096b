"""The registered queries and the pipeline over whole tables, against brute force."""

import hashlib
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from test_llm_jaccard import brute as jaccard_brute
from test_llm_scans import brute_secrets, brute_url

import __spark_entry__
import corpus_pipeline
from notelake.llm import leaks, queries

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows(spark, sf_dir, name):
    return __spark_entry__.queries()[name](spark, sf_dir).collect()


def test_all_are_registered():
    names = [re.match(r"op(\d+)_", n) for n in __spark_entry__.queries()]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_jaccard_join(spark, sf_dir, documents):
    got = sorted((f"{r.doc_id:019d}", r.n_shingles, f"{r.component_id:019d}") for r in rows(spark, sf_dir, "op1_jaccard_join"))
    assert got == [(p, n, c) for _, p, n, _, c in jaccard_brute([("d", f"{i:019d}", r.text) for i, r in documents.items()])]


def test_token_files(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json")), 0, []
    for i in sorted(documents):
        ids = [*plain.encode(documents[i].text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows(spark, sf_dir, "op2_token_files"))) == want


def test_suffix_dedup(spark, sf_dir, documents):
    seen, want = set(), []
    for i in sorted(documents):
        data = documents[i].text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            part = data[k : k + 100]
            if part in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(part)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        want.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, rows(spark, sf_dir, "op3_suffix_dedup"))) == want


def test_benchmark_leaks(spark, sf_dir, documents):
    items = {r.item_id: leaks.folded(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(i, k) for i, r in documents.items() for k, t in items.items() if t in leaks.folded(r.text)}
    got = rows(spark, sf_dir, "op4_benchmark_leaks")
    assert want and {(r.doc_id, r.item_id) for r in got if r.coverage == 1.0} == want


def test_license_scan(spark, sf_dir, documents):
    lines = {"Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3."}
    want = {i for i, r in documents.items() if any(line in r.text for line in lines)}
    assert {r.doc_id for r in rows(spark, sf_dir, "op5_license_scan")} == want


def test_url_filter(spark, sf_dir):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = rows(spark, sf_dir, "op6_url_filter")
    assert len(got) == len(url)
    for r in got:
        host, path, rule, verdict = brute_url(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ({verdict} if verdict else {"allow", "block"})


def test_secret_scan(spark, sf_dir, documents):
    for r in rows(spark, sf_dir, "op7_secret_scan"):
        base = brute_secrets(documents[r.doc_id].text)
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[2] == k for b in base) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == [s for s in joined.split(",") if s]


def test_pipeline(spark, sf_dir, documents):
    """Exact copies, then near copies, then leaks, with what is left encoded."""
    left = {i: r.text for i, r in documents.items() if re.search(r"[^\W\d_]", r.text or "")}
    groups = {}
    for i, text in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}
    near = jaccard_brute([("d", f"{i:019d}", t) for i, t in left.items()])
    left = {int(p): left[int(p)] for _, p, _, _, c in near if p == c}
    items = [leaks.folded(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(item in leaks.folded(t) for item in items)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == left and len(got) == len(left)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "jaccard_join", "decontaminate", "piece_ids"]


ODD = [
    (1, "one two three four five six", "en", "a", 5), (1, "one two three four five six", "en", "a", 5), (2, None, "en", None, None),
    (3, "", None, "a", 0), (4, "123 456", "en", "a", 7), (None, "seven eight nine ten eleven", "en", "a", 1), (5, "word " * 30_000, "de", "a", 1),
    (6, "one  two three four five six", "en", "a", 6),
]


def test_stages_take_odd_tables(spark, sf_dir):
    """NULLs, empty texts, repeated rows, columns of any name, and no rows at all."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({"vault": F.lit("x"), "path": F.lit(1), "kept": F.lit(None).cast("string")})
    want = {
        "language": [None, 1, 1, 5, 6],
        "exact_dedup": [None, 2, 4, 5, 6],
        "jaccard_join": [None, 1, 1, 2, 3, 4, 5],
        "decontaminate": [None, 1, 1, 2, 3, 4, 5, 6],
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        if name in want:
            assert set(got.columns) == set(docs.columns)
            assert sorted((r.doc_id for r in got.collect()), key=lambda v: (v is not None, v)) == want[name], name
        else:
            assert {(r.doc_id, r.text) for r in got.collect()} == {(i, t or "") for i, t, *_ in ODD}
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_the_rest_stands_without_this_subpackage(tmp_path):
    for part in ("__spark_entry__.py", "notelake"):
        source = ROOT / part
        for file in [source] if source.is_file() else source.rglob("*.py"):
            if "llm" not in file.parts:
                target = tmp_path / file.relative_to(ROOT)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(file.read_bytes())
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
