"""run() against a brute-force walk through the same stages, and the guard of the driver entry."""

import math
import random
import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import quality_rules
from sparkloom.llm import pipeline as corpus_pipeline
from tests.llm.test_operators import WS, brute_figures, brute_jaccard, prose


def brute_kept(texts, good):
    grams = lambda t: [int.from_bytes(b, "big") * 2654435761 % 2**32 >> 16 for b in ((t or "").encode()[i : i + 4] for i in range(len((t or "").encode()) - 3))]
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        target.update(grams(t) if i in good else [])
    n, m, v = raw.total(), target.total(), quality_rules.BUCKETS
    prior = 1 + quality_rules.PRIOR * m

    def ratio(g):
        b = (raw[g] + 1) / (n + v)
        return math.log((target[g] + prior * b) / (m + prior)) - math.log(b)

    for i, t in texts.items():
        f, g = brute_figures(t), grams(t)
        if f[0] >= 50 and 100 * f[4] <= 50 * f[0] and (not g or sum(map(ratio, g)) / len(g) >= quality_rules.THRESHOLD):
            yield i


def brute_pipeline(texts, source, good):
    now = {i: texts[i] for i in brute_kept(texts, good)}
    sites, first = defaultdict(set), {}
    for i in sorted(now):
        for p, line in enumerate(now[i].split("\n")):
            if re.search(WS, line):
                sites[line].add(source[i])
                first.setdefault(line, (i, p))
    now = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if len(sites[x]) < 15 or first[x] == (i, p)) for i, t in now.items()}
    found = brute_jaccard(now)
    now = {i: t for i, t in now.items() if found[i][1] == i}
    seen, out = set(), {}
    for i in sorted(now):
        w, gone = re.findall(WS, now[i]), set()
        for p in range(len(w) - 19):
            if tuple(w[p : p + 20]) in seen:
                gone |= set(range(p, p + 20))
            seen.add(tuple(w[p : p + 20]))
        out[i] = len(w) - len(gone)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(6), tmp_path_factory.mktemp("sf")
    line, passage, texts = "one line that stands on every site of all", prose(rng, 40), {}
    for i in range(90):
        t = prose(rng, rng.choice([20, 70, 150]))
        t += "\n" + (line if i % 2 else prose(rng, 9)) + "\n" + (passage if i % 7 == 0 else prose(rng, 30))
        t = t.replace(" ", "## ") if i % 9 == 8 else t
        texts[i] = texts[i - 1] if i % 10 == 5 else t
    rows = [(i, t, "en", f"s{i % 20}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    good = {i for i in texts if i % 9 != 8 and i % 2}
    spark.createDataFrame([(i, int(i in good), 0) for i in texts if i % 2 or i % 9 == 8], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), texts, {i: f"s{i % 20}" for i in texts}, good


def test_run_equals_brute_force(spark, folder):
    d, texts, source, good = folder
    got = Counter()
    for r in corpus_pipeline.run(spark, d).collect():
        got[r["doc_id"]] += r["n_tokens"]
    want = brute_pipeline(texts, source, good)
    assert dict(got) == want and 0 < len(want) < len(texts)


def test_stages_keep_the_columns(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_near_duplicates_on_odd_rows(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(1)
    many = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.withColumn("text", F.lit("other")))
    out = corpus_pipeline.near_duplicates(spark, many, d)
    assert out.where("doc_id is null").count() == 1 and out.columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), d).count() == 0


def test_entry_works_without_this_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    code = "import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    shutil.copytree(root / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_stages_with_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls, empties, repeats, ties, empty tables and clashing column names pass every stage, which gives back the columns it got."""
    from sparkloom.llm import pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, kept_id_ int, row string, one string, text_ string, gone int, rk long, id int, n_links int, component_id int"
    words = " ".join(f"w{i}" for i in range(70))
    texts = [words, words, None, "", " \n", words + " more", words.upper(), words]
    rows = [(None if i == 5 else min(i, 6), t, "en", "s", 1, 7, 8, "r", "o", "t", 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for _name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []
        got = out.collect()
        assert all((r["row"], r["one"], r["kept_id"], r["n_links"]) == ("r", "o", 7, 4) for r in got)
        if stage is pipeline.line_dedup or stage is pipeline.substring_dedup:
            assert len(got) == len(rows)
        if stage is pipeline.near_duplicates:
            # ids 0, 1, 6 and the null id are one component, whose first, the null id, stays; null and empty texts stay
            assert sorted(repr(r["doc_id"]) for r in got) == ["2", "3", "4", "None"]
    assert pipeline.packing(spark, docs, str(tmp_path)).count() >= 5 and pipeline.packing(spark, docs.where("false"), str(tmp_path)).collect() == []
