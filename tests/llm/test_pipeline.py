import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from test_text_operators import brute_components, brute_lines

from tessera.llm import mixing

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark):
    rng = random.Random(11)
    vocabulary = {x: [f"{x}{''.join(rng.choice(letters) for _ in range(4))}" for _ in range(300)] for x, letters in (("en", "thwink"), ("de", "schüß"), ("fr", "éèeaux"))}
    line = lambda x: " ".join(rng.choice(vocabulary[x]) for _ in range(rng.choice([4, 12, 30])))
    rows = []
    for i in range(90):
        x = rng.choice(list(vocabulary))
        rows.append((i, "\n".join(line(x) for _ in range(rng.randrange(1, 5))), x, f"s{i % 4 if i % 3 else 0}", 0))
    shared = line("en")
    rows = [(i, t + "\n" + shared if i % 9 == 0 else t, x, s, n) for i, t, x, s, n in rows]
    long = " ".join(rng.choice(vocabulary["en"]) for _ in range(400))
    rows += [(200, long, "en", "s1", 0), (201, long.replace(long.split()[50], "changed", 1), "en", "s2", 0), (300, "12 34 !!", "en", "s1", 0), (301, None, None, None, None), (302, "", "en", None, 0)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_stages_one_after_the_other(spark, tmp_path):
    rows, docs = fixture(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        kept[name], before, now = spark.read.parquet(path).collect(), now, spark.read.parquet(path)
        if name != "packing":
            assert now.columns == docs.columns
    first = kept["language ID"]
    assert {r["doc_id"] for r in first} == {r[0] for r in rows} - {300, 301, 302}
    second = kept["line dedup"]
    assert sorted((r["doc_id"], r["text"]) for r in second) == brute_lines([(r["doc_id"], r["text"]) for r in first])
    assert all(r["n_chars"] == len(r["text"]) for r in second)
    groups = brute_components([(r["doc_id"], r["text"]) for r in second])
    third = kept["MinHash near-dedup"]
    assert sorted(groups[r["doc_id"]][1] for r in third) == sorted({c for _, c in groups.values()})
    fourth = kept["mixing sources"]
    assert sorted(fourth) == sorted(third)
    total = {r["doc_id"]: 0 for r in fourth}
    for r in kept["packing"]:
        total[r["doc_id"]] += r["length"]
    assert total == {r["doc_id"]: r["doc_tokens"] for r in kept["packing"]} and set(total) == {r["doc_id"] for r in fourth}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, kept["packing"]))


def test_packing_follows_the_mixture(spark, tmp_path):
    """Other weights of the sources give other sequences, opened in the order of the mixture."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", f"s{i % 2}", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out, first = {}, {}
    for name, weights in (("a", {"s0": 1.0, "s1": 0.0}), ("b", {"s0": 0.0, "s1": 1.0})):
        mixing.mix(docs, weights).write.parquet(str(tmp_path / name))
        out[name] = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / name)), "").collect()
        first[name] = min((r["sequence_id"], r["offset"], r["doc_id"]) for r in out[name])[2]
    assert sorted(map(tuple, out["a"])) != sorted(map(tuple, out["b"]))
    assert (first["a"] % 2, first["b"] % 2) == (0, 1)


def test_packing_asks_with_whole_texts(spark, tmp_path):
    """The partner shares many words that others have too; a decoy shares the eight rarest."""
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(8)]
    texts = {0: common + rare, 1: rare + [f"x{i}" for i in range(60)], 2: common + ["y"]}
    texts |= {i: rng.sample(common, 12) + [f"z{i}n{k}" for k in range(48)] for i in range(3, 60)}
    spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in texts.items()], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    assert order[:2] == [0, 2]


def test_stages_free_the_driver(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "release", lambda s: calls.append(s))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, fixture(spark)[1].limit(0), "")
        assert calls == [spark] * (n + 1)


def test_documents_without_an_id_and_with_one_id_are_judged_each(spark):
    long = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(None, long("a")), (None, long("b")), (5, long("a")), (7, long("c")), (7, long("b")), (7, long("c")), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(str(r["text"])[:2] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect())
    assert got == ["No", "a0", "b0", "c0", "c0"]


def test_stages_take_an_empty_table_and_extra_columns(spark):
    _, docs = fixture(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []
    more = docs.selectExpr("*", "'z' first", "1 rows", "2 component_id", "3 accepted", "4 n_lines_", "5 label").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, "")
        assert out.columns == more.columns and out.count() > 0


def test_library_does_not_need_the_subpackage():
    """Without the folder and the pipeline the entry still imports, and nothing else in the library names the subpackage."""
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name.startswith('tessera.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name, name='corpus_pipeline' if name == 'corpus_pipeline' else 'tessera.llm')\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert e.queries() and e.oracle_sql() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    broken = code.split("sys.meta_path.insert")[0].replace("name.startswith('tessera.llm') or name == 'corpus_pipeline'", "name == 'tiktoken'").replace("name='corpus_pipeline' if name == 'corpus_pipeline' else 'tessera.llm'", "name=name") + "sys.meta_path.insert(0, Gone())\nimport tessera.llm.tokens as t\ntry:\n    t.tiktoken_encoding(t.default_vocabulary())\nexcept ModuleNotFoundError:\n    pass\nelse:\n    raise SystemExit(1)"
    subprocess.run([sys.executable, "-c", broken], cwd=ROOT, check=True)
    users = [p for p in ROOT.glob("tessera/**/*.py") if "llm" not in p.parts and "tessera.llm" in p.read_text()]
    assert users == []
