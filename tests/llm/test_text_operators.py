import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import exact_dedup, line_dedup, minhash_dedup, mixing, packing, secrets, shingles, tokens

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", None) if not isinstance(t, tuple) else (*t, "en", None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# Exact dedup


def test_exact_dedup_ties_nulls_and_bytes(spark):
    rows = [(5, "a b"), (3, "ab"), (9, " a\tb\n"), (1, None), (2, ""), (7, " "), (4, "é"), (6, "é"), (8, "ab "), (8, "ab "), (None, "ab")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket_entries=1).collect()}
    ab = {(i, 9, 6, i == 9) for i in (5, 3, 9, 8, None)}
    assert got == ab | {(1, 7, 3, False), (2, 7, 3, False), (7, 7, 3, True), (4, 4, 1, True), (6, 6, 1, True)}
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_owner_chains_equal_keys_and_compares_bytes():
    import pyarrow as pa

    key = -(1 << 62)
    batch = pa.RecordBatch.from_pydict({"key": pa.array([key] * 4, pa.int64()), "digest": ["y", "x", "y", "x"], "form": [None, "one", "two", "one"], "best_chars": pa.array([3, 3, 4, 5], pa.int64()), "best_id": pa.array([7, 1, 2, 3], pa.int64()), "copies": pa.array([4, 2, 1, 1], pa.int64())})
    (out,) = exact_dedup._own(4, 3)(iter([batch]))
    assert list(zip(out["digest"].to_pylist(), out["keep_id"].to_pylist(), out["group_size"].to_pylist(), strict=True)) == [("x", 3, 3), ("y", 2, 5)]


def test_a_long_text_is_sent_once_per_task(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact_dedup, "PIECE_BYTES", 40)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "n": pa.array([30, 31], pa.int64()), "form": ["x" * 30, "y"], "digest": ["dx", "dy"], "key": pa.array([5, 6], pa.int64())})
    first, second = exact_dedup._fold(iter([batch, batch]))
    assert first["form"].to_pylist() == ["x" * 30, "y"] and second["form"].to_pylist() == [None, "y"] and second["copies"].to_pylist() == [1, 1]


@pytest.mark.parametrize("capacity", [1, 4])
def test_rows_are_found_through_directory_and_buckets(spark, capacity, tmp_path):
    rng = random.Random(capacity)
    rows = [(i, " ".join(words(rng, 3, 12))) for i in range(400)]
    index = exact_dedup.build_index(exact_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string")), capacity, 2)
    slots = {(r["owner"], r["slot"]): r["bucket"] for r in index.directory.collect()}
    bits = {r["owner"]: r["bits"] for r in index.owners.collect()}
    assert max(bits.values()) > 3 and all({s for o, s in slots if o == owner} == set(range(1 << n)) for owner, n in bits.items())
    for r in index.entries.collect():
        key = r["key"] & (1 << 64) - 1
        depth = r["bucket"].bit_length() - 1
        assert (1 << depth) | key >> (64 - depth) == r["bucket"] == slots[key >> 62, (key << 2 & (1 << 64) - 1) >> (64 - bits[key >> 62])]
    assert max(r["count"] for r in index.entries.groupBy("bucket").count().collect()) <= capacity
    index.save(str(tmp_path / "index"))
    held = exact_dedup.Index.load(spark, str(tmp_path / "index"), 2)
    later = exact_dedup.keyed(spark.createDataFrame([(900, rows[7][1].replace(" ", "")), (901, "not there")], "doc_id long, text string")).select("doc_id", "key", "digest")
    found = {r["doc_id"]: r["group_size"] for r in held.probe(later, "left").collect()}
    assert found == {900: sum(t.replace(" ", "") == rows[7][1].replace(" ", "") for _, t in rows), 901: None}


def test_entries_take_fewer_files_than_there_are_owner_tasks(spark):
    rng = random.Random(7)
    rows = [(i, "%032768x" % rng.getrandbits(4 << 15)) for i in range(300)]
    entries = exact_dedup.build_index(exact_dedup.texts(spark.createDataFrame(rows, "doc_id long, text string"))).entries
    assert len(entries.inputFiles()) == 1 and entries.count() == 300


def test_texts_are_keyed_the_same_on_their_way_to_owners_and_probes(spark):
    rows = [(1, " a\x0b\x0cb\r"), (2, "\u3000\u00a0\x85"), (3, "\U0001f600 \n"), (4, None), (5, "\x00\x1f"), (6, "ab")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in exact_dedup.keyed(frame).collect():
        form = "".join(c for c in (dict(rows)[r["doc_id"]] or "") if c not in " \t\n\x0b\x0c\r")
        digest = hashlib.sha256(form.encode()).hexdigest()
        assert (r["form"], r["digest"], r["key"] & (1 << 64) - 1, r["n"]) == (form, digest, int(digest[:16], 16), len(dict(rows)[r["doc_id"]] or ""))
    columns = ["doc_id", "key", "digest"]
    assert sorted(exact_dedup.keyed(frame, forms=False).select(columns).collect()) == sorted(exact_dedup.keyed(frame).select(columns).collect())
    entries = [sorted(exact_dedup.build_index(x).entries.collect()) for x in (exact_dedup.texts(frame), exact_dedup.keyed(frame))]
    assert entries[0] == entries[1] and len(entries[0]) == 5


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_buckets_split_on_prefix_bits(capacity):
    rng = random.Random(capacity)
    keys = sorted(rng.getrandbits(61) | (5 << 61) for _ in range(300)) + [(1 << 64) - 1] * 4
    buckets = exact_dedup.split_buckets(keys, 0, 0, capacity)
    assert [k for _, _, s, e in buckets for k in keys[s:e]] == keys or sorted(k for _, _, s, e in buckets for k in keys[s:e]) == keys
    for prefix, bits, s, e in buckets:
        assert all(k >> (64 - bits) == prefix for k in keys[s:e]) and (e - s <= capacity or len(set(keys[s:e])) == 1)


# Line dedup


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_same(w, o):
    """Over words if both lines have enough, else over characters."""
    if min(len(w), len(o)) >= 8:
        return abs(len(w) - len(o)) <= 1 and brute_distance(w, o) <= 1
    x, y = " ".join(w), " ".join(o)
    return min(len(x), len(y)) >= 10 and abs(len(x) - len(y)) <= 1 and brute_distance(x, y) <= 1


def brute_lines(rows):
    seen, out = [], []
    for doc_id, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            w = line.split()
            if w and any(w == o or brute_same(w, o) for o in seen):
                seen.append(w)
                continue
            if w:
                seen.append(w)
            kept.append(line)
        out.append((doc_id, "\n".join(kept)))
    return out


def edit(rng, line):
    w = list(line)
    if not w:
        return ["x"]
    if rng.randrange(2):
        text = " ".join(w)
        i = rng.randrange(len(text))
        return (text[:i] + rng.choice(["", "é", " ", "q"]) + text[i + rng.randrange(2) :]).split() or ["x"]
    i, kind = rng.randrange(len(w)), rng.randrange(3)
    if kind == 0:
        w[i] = "new" + str(rng.randrange(50))
    elif kind == 1:
        del w[i]
    else:
        w.insert(i, "ins" + str(rng.randrange(50)))
    return w


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([1, 2, 7, 8, 9, 10, 11, 15, 30])) for _ in range(40)]
    pool = base + [edit(rng, x) for x in base for _ in range(3)]
    pool += [edit(rng, x) for x in pool[40:90]]
    rows = [(i, "\n".join((" " * rng.randrange(2)) + " ".join(rng.choice(pool)) for _ in range(rng.randrange(1, 8)))) for i in range(60)]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_lines(rows)


def test_line_dedup_odd_rows(spark):
    long = "\n".join(f"line number {i} of a very long text with words" + " x" * (i % 5) for i in range(3000))
    rows = [(1, None, 7), (2, "", 7), (3, "one\n\n\none", 7), (4, "one", 7), (5, "two", 7), (5, "two", 7), (None, "two", 7), (6, long, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines long").withColumnRenamed("n_lines", "n_dropped")
    got = [(r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame).collect()]
    assert len(got) == 8
    assert {x[:2] for x in got if x[0] != 6} == {(1, None), (2, ""), (3, "one\n\n"), (4, ""), (5, "two"), (None, "")}
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_line_dedup_keeps_the_first_line_of_repeated_rows(spark):
    a, b, near = "a b c d e f g h i j", "a b c d e f v w x y", "a b c d e f g h i other"
    rows = [(1, a), (1, a), (2, f"{b}\n{near}"), (2, f"{b}\n{near}"), (None, f"{a}\nk l m n o p q r s t"), (None, f"{a}\nk l m n o p q r s t"), (3, "k l m n o p 1 2 3 4")]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, a), (1, a), (2, b), (2, b), (3, rows[-1][1]), (None, "k l m n o p q r s t"), (None, "k l m n o p q r s t")], key=str)


def thue_morse(n):
    """Two different texts of 2 ** n letters whose polynomials modulo 2 ** 64 are equal for every odd base."""
    text = "a"
    for _ in range(n):
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_texts_that_collide_as_polynomials_stay_apart(spark):
    x, y = thue_morse(10)
    for rows in ([(1, x), (2, y)], [(1, f"p q r s {x} t u v w z"), (2, f"p q r s {y} t u v w z {x}")], [(1, " ".join(x)), (2, " ".join(y))]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert [r["text"] for r in line_dedup.dedup_lines(frame).orderBy("doc_id").collect()] == [t for _, t in brute_lines(rows)] == [t for _, t in rows]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame).collect()}
        assert got == brute_components(rows)


def test_short_lines_have_a_neighbourhood(spark):
    rows = [(1, "Subscribe to our newsletter\nPage 1\n2\nab cd ef gh ij kl mn op"), (2, "Subscribe to our newsletters\nPage 2\n3\nab cd ef gh ij kl mnop")]
    got = [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [rows[0][1], "Page 2\n3"]


@pytest.mark.parametrize("n", range(8, 70))
def test_half_never_exceeds_half(n):
    assert 3 <= line_dedup.half(np.array([n]))[0] <= (n - 1) / 2


# MinHash near-dedup


def brute_components(rows, threshold=75):
    sets = {}
    for i, t in rows:
        w = shingles.plain((t or "").encode()).split(b" ") if (t or "").split() else []
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        base = words(rng, rng.choice([20, 60, 200]), 3000)
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(999)}"
            texts.append(" ".join(w))
    texts += ["", None, " \n", "A b", "a  B", "one two three four", texts[0].upper(), texts[5] + "\n"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=5).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_star_without_its_centre_first(spark):
    """Copies are linked through a base that comes last: only together they are one group."""
    rng = random.Random(9)
    base = words(rng, 400, 90_000)
    rows = []
    for i in range(40):
        w = list(base)
        for at in range(i % 7, 400, 29):
            w[at] = f"c{i}_{at}"
        rows.append((i, " ".join(w)))
    rows.append((99, " ".join(base)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == brute_components(rows)


def test_strays_beside_a_large_component_are_dealt_in_proportion(spark):
    def dealt(n):
        members = spark.range(n).selectExpr("7L as key", "id as doc_id", "if(id < 16, id, 99) as component")
        return minhash_dedup._dealt(members, 64).count()

    assert dealt(4096) <= 2.2 * dealt(2048) and dealt(2048) <= 2.2 * dealt(1024)
    pairs = minhash_dedup._dealt(spark.range(40).selectExpr("7L as key", "id as doc_id", "id % 3 as component"), 4).collect()
    met = {}
    for r in pairs:
        met.setdefault((r["i"], r["j"]), set()).add(r["doc_id"])
    assert all(any({x, y} <= g for g in met.values()) for x in range(40) for y in range(40) if x % 3 != y % 3)


def test_near_duplicates_odd_rows(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, None, "x")]
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, rep string")).collect())
    assert got == [(-1, 2, False), (2, 2, True), (2, 2, True), (3, 3, True)]


def test_shingles_of_long_texts_are_whole(monkeypatch):
    text = " ".join(words(random.Random(1), 5000, 2000)).encode()
    whole = shingles.shingle_sets([b"x y", text, b""])
    monkeypatch.setattr(shingles, "SEGMENT_BYTES", 300)
    cut = shingles.shingle_sets([b"x y", text, b""])
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and [len(s) for s in cut] == [1, len({tuple(text.split()[i : i + 5]) for i in range(4996)}), 0]


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for n in (4, 50, 1000):
        for share in (0.25, 0.75):
            sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(100)]
            other = [np.concatenate((s[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64))) for s in sets]
            true = int(n * share) / (2 * n - int(n * share))
            same = (shingles.super_minhash([np.sort(s) for s in sets], 128) == shingles.super_minhash([np.sort(s) for s in other], 128)).mean(axis=1)
            assert abs(same.mean() - true) < 0.02
            errors.append(same.std() / (true * (1 - true) / 128) ** 0.5)
    assert errors[0] < 0.8  # small sets: less variance than independent permutations


# Packing


def test_packing_is_a_partition_without_padding(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.choice([0, 1, 5, 200, 900, 4000]), 300)) for _ in range(120)] + [None, "", "日本語のテキスト", "a b <|endoftext|>"]
    frame = docs(spark, texts)
    got = packing.pack(frame).collect()
    encode = tokens.encoder(tokens.default_vocabulary())
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids, at = np.append(encode(text or ""), 0).astype("<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        total = sum(r["length"] for r in rows)
        assert total == 1024 or total < 1024 and total & (total - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    exact, encode = Tokenizer.from_file(path), tokens.encoder(path)
    for text in ("Hello  world\n\n it's 12,345 — größer élan", "\t tabs\r\nand   spaces  ", "ñandú'll I'VE don't", "x" * 500, "日本 🙂     end"):
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def brute_neighbours(texts, k):
    """Row -> the k best (score, row) after it, by scoring every document for the row's query."""
    path = tokens.default_vocabulary()
    encode, opens = tokens.encoder(path), packing.word_openers(path)
    ids = [np.append(encode(t or ""), 0) for t in texts]
    found = []
    for x in ids:
        words, held = [], []
        for i in x.tolist():
            if opens[i] and held:
                words.append(tuple(held))
                held = []
            held.append(i)
        found.append(collections.Counter([*words, tuple(held)]))
    df = collections.Counter(w for f in found for w in f)
    number = {w: int(packing.document_terms([np.array(w)], opens)[0][0]) for w in df}
    mean, out = sum(map(len, ids)) / len(ids), {}
    for i, f in enumerate(found):
        query = sorted((w for w in f if df[w] > 1), key=lambda w: (min(df[w], 255), number[w]))[: packing.QUERY_TERMS]
        query = [w for n, w in enumerate(query) if n == 0 or sum(df[x] for x in query[: n + 1]) <= packing.QUERY_POSTINGS]
        scores = []
        for j in range(i + 1, len(ids)):
            idf = {w: np.log1p((len(ids) - df[w] + 0.5) / (df[w] + 0.5)) for w in query}
            length = packing.K1 * (1 - packing.B + packing.B * len(ids[j]) / mean)
            score = sum(round(1024 * idf[w] * found[j][w] * (packing.K1 + 1) / (found[j][w] + length)) for w in query if w in found[j])
            if score:
                scores.append((-score, j))
        out[i] = [(-x, j) for x, j in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


def test_packing_retrieves_over_all_documents(spark):
    """Recall of the neighbours against brute force over all documents is 1."""
    rng = random.Random(9)
    texts = [" ".join(words(rng, rng.randrange(5, 80), 700)) for _ in range(80)] + [None, "", "w1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    held, counters = packing.tokenised(frame, tokens.default_vocabulary())
    at = {r["row"]: r["doc_id"] for r in held.select("row", "doc_id").collect()}
    by_doc = held.withColumn("row", held["doc_id"])  # rows in the order of ids
    got = {r["row"]: [(x["score"], x["other"]) for x in r["best"]] for r in packing.neighbours(packing.postings(by_doc, counters)).collect()}
    want = brute_neighbours(texts, packing.NEIGHBOURS)
    assert len(at) == len(texts) and set(got) == set(want)
    assert all([abs(x - y) <= 8 for (x, _), (y, _) in zip(got[i], want[i], strict=True)] for i in got)
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_a_term_in_many_documents_has_shards(spark, monkeypatch):
    """A term that all documents have is cut into shards: pairs grow with documents times a shard's size, and all are packed."""
    monkeypatch.setattr(packing, "SHARD_POSTINGS", 8)
    texts = ["common words only here"] * 200
    index = packing.postings(*packing.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokens.default_vocabulary()))
    assert index.groupBy("term", "shard").count().agg({"count": "max"}).first()[0] <= 24
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=32).collect()
    assert sorted({r["doc_id"] for r in got}) == list(range(200))


def test_packing_joins_partners(spark):
    """Of each pair of near copies one follows the other."""
    rng = random.Random(4)
    pairs = [" ".join(f"p{k}q{rng.randrange(3000)}" for _ in range(40)) for k in range(20)]
    frame = docs(spark, pairs + [t + " more" for t in pairs])
    by_sequence = {}
    for r in packing.pack(frame, window=1 << 14).collect():
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"] % 20))
    order = [d for x in by_sequence.values() for _, d in sorted(x)]
    assert sum(a == b for a, b in zip(order, order[1:])) >= 18


def brute_nearest(texts, seeds):
    """Row -> (score, seed): the best of the seeds (of the earlier ones, for a seed) for whole texts."""
    encode, opens = tokens.encoder(tokens.default_vocabulary()), packing.word_openers(tokens.default_vocabulary())
    ids = [np.append(encode(t or ""), 0) for t in texts]
    found = []
    for x in ids:
        terms, tf, _ = packing.document_terms([x], opens)
        found.append(dict(zip(terms.tolist(), tf.tolist(), strict=True)))
    df = collections.Counter(w for f in found for w in f)
    mean, out = sum(map(len, ids)) / len(ids), {}
    for d, f in enumerate(found):
        weight = {w: int(packing.bm25_weight(np.array([n]), np.array([df[w]]), np.array([len(ids[d])]), len(ids), mean)[0]) for w, n in f.items()}
        scores = [(sum(weight[w] for w in found[s] if w in f), -s) for s in seeds if s < d or d not in seeds]
        if scores and max(scores)[0] > 0:
            out[d] = (max(scores)[0], -max(scores)[1])
    return out


def test_seeds_ask_with_whole_texts_over_all_documents(spark, monkeypatch):
    """Every document is given its best seed, whatever the blocks, columns and terms that all documents have."""
    rng = random.Random(12)
    texts = [" ".join(words(rng, rng.randrange(5, 300), 400) + ["all of them"]) for _ in range(90)] + [None, "", "w1", "alone"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for seeds, block, dense in (("doc_id % 10 = 0", 1 << 20, 16), ("doc_id % 10 = 0", 1 << 20, 1), ("true", 4000, 4)):
        monkeypatch.setattr(packing, "BLOCK_TERMS", block)
        monkeypatch.setattr(packing, "DENSE", dense)
        held, _ = packing.tokenised(frame, tokens.default_vocabulary(), seeds=seeds, counted=False)
        got = {r["row"]: (r["score"], r["seed"]) for r in packing.nearest(held.withColumn("row", held["doc_id"])).collect()}
        assert got == brute_nearest(texts, range(len(texts)) if seeds == "true" else range(0, len(texts), 10))


def test_packing_is_not_led_by_the_rarest_terms_alone(spark):
    """The partner shares many words that others have too; a decoy shares the eight rarest."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    rare = [f"r{i}" for i in range(8)]
    texts = {0: common + rare, 1: rare + [f"x{i}" for i in range(60)], 2: common + ["y"]}
    texts |= {i: rng.sample(common, 12) + [f"z{i}n{k}" for k in range(48)] for i in range(3, 60)}
    got = packing.pack(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"), window=1 << 14, seeds="doc_id % 100 = 0").collect()
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    assert order[:2] == [0, 2]


def test_seeds_are_ordered_depth_first(spark):
    found = spark.createDataFrame([(2, 5, 0), (4, 9, 0), (6, 9, 4), (8, 1, 2), (3, 7, 0)], "row long, score long, seed long")
    got = packing.seed_order(spark.createDataFrame([(i,) for i in (0, 2, 4, 6, 8, 10)], "row long"), found)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0), (2, 0, 3), (4, 0, 1), (6, 0, 2), (8, 0, 4), (10, 10, 0)]


def test_matching_gives_each_row_one_place(spark):
    best = spark.createDataFrame([(0, [(9, 3), (8, 4)]), (1, [(7, 3), (6, 4)]), (2, [(7, 3), (5, 4)]), (3, [(1, 5)])], "row long, best array<struct<score long, other long>>")
    assert sorted(map(tuple, packing.matched(best).collect())) == [(0, 3), (1, 4), (3, 5)]
    rows = spark.createDataFrame([(i, 10 + i) for i in range(6)], "row long, n long")
    links = spark.createDataFrame([(0, 2), (2, 5), (1, 3)], "row long, follows long")
    assert sorted(map(tuple, packing.chains(rows, links).collect())) == [(0, 0, 0), (1, 1, 0), (2, 0, 10), (3, 1, 11), (4, 4, 0), (5, 0, 22)]


def test_packing_odd_rows(spark):
    """Null and repeated doc_ids are packed each; columns with the operator's own names are ignored."""
    rows = [(None, "a b c", "x", 1), (None, "a b c", "x", 1), (4, "a b c", "x", 1), (4, None, "x", 1), (4, None, "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ids string, row long"), window=4).collect()
    assert sorted(((r["doc_id"] or -1), r["start"], r["length"]) for r in got if r["doc_id"] is None or r["doc_tokens"] > 1) and sum(r["length"] for r in got) == 3 * 4 + 2
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 8


# Secrets


def test_base_spans_follow_the_patterns():
    text = 'x PassWord = "abcdefgh" token:short api-key=zzzzzzzzz API_KEY=\'0123456789\' AKIAABCDEFGHIJKL AKIASHORT ' + "f" * 31 + "g" + "0a" * 16
    assert [(text[s:e], k) for s, e, k in sorted(secrets.base_spans(text))] == [('PassWord = "abcdefgh', "assign"), ("API_KEY='0123456789", "assign"), ("AKIAABCDEFGHIJKL", "access"), ("0a" * 16, "hex")]


def test_secret_scan_equals_brute_force(spark):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(letters) for _ in range(36))
    texts = [f"ünï — see {key} there", "the documentation_of_this_function and InternationalizationSupport", f"id 123e4567-e89b-12d3-a456-426614174000 and {'ab' * 20}", None, "", "secret=" + "a" * 9, "é" * 50 + f" token = '{key}'", "AKIA" + "Z9" * 10, "x " * 50_000 + key]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs(spark, texts)).collect()}
    encoding = tokens.tiktoken_encoding(tokens.default_vocabulary())
    import re

    for i, text in enumerate(t or "" for t in texts):
        base = secrets.base_spans(text)
        spans = base + [(m.start(), m.end(), "random") for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", text) if not any(s < m.end() and m.start() < e for s, e, _ in base) and secrets.is_random(m[0], encoding)]
        write = lambda rows: ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(rows, key=lambda x: (x[0], secrets.KINDS.index(x[2]))))
        assert (got[i]["spans"], got[i]["base_sha256"]) == (write(spans), hashlib.sha256(write(base).encode()).hexdigest())
    assert [got[i]["n_random"] for i in range(9)] == [1, 0, 0, 0, 0, 0, 0, 0, 1]


def test_letters_are_words_unless_their_tokens_are_short():
    encoding = tokens.tiktoken_encoding(tokens.default_vocabulary())
    assert not any(secrets.is_random(x, encoding) for x in ("internationalization", "Counterrevolutionary", "UNCHARACTERISTICALLY", "characteristically"))
    rng = random.Random(1)
    found = [secrets.is_random("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)), encoding) for _ in range(100)]
    assert sum(found) >= 80


def test_secrets_of_odd_rows(spark):
    """Null ids and repeated rows are judged each; columns with the result's names are ignored; an empty table gives nothing."""
    key = "Zx9Kq2Lm8Vb4Tn6Wp1Rs"
    rows = [(None, f"see {key}", "x", 1), (None, f"see {key}", "x", 1), (3, None, "x", 1), (3, f"password = {key}", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex long")
    got = sorted(((r["doc_id"] or -1), r["spans"]) for r in secrets.scan_secrets(frame).collect())
    assert got == [(-1, "random:4:24"), (-1, "random:4:24"), (3, ""), (3, "assign:0:31")]
    assert secrets.scan_secrets(frame.limit(0)).collect() == []


# Mixing


@pytest.mark.parametrize("seed", range(40))
def test_schedule_keeps_every_window(seed):
    rng = random.Random(seed)
    blocks = [rng.randint(1, 50) for _ in range(rng.randint(1, 8))]
    weights = [rng.choice([0.0, rng.random(), 10 * rng.random(), 1 / 3]) for _ in blocks]
    windows, placed = mixing.fluid_windows(blocks, weights), [0] * len(blocks)
    for slot, (s, j) in enumerate(mixing.edf_schedule(blocks, weights)):
        release, deadline = windows[s][j]
        assert placed[s] == j and release <= slot < deadline
        placed[s] += 1
    assert placed == blocks


def test_fluid_time_equals_a_simulation():
    rng = random.Random(1)
    blocks, weights = [rng.randint(1, 30) for _ in range(6)], [rng.random() + 0.1 for _ in range(6)]
    time, got, now, step = mixing.fluid_time(blocks, weights), [0.0] * 6, 0.0, 1e-3
    for _ in range(int(sum(blocks) / step)):
        active = [s for s in range(6) if got[s] < blocks[s]]
        total = sum(weights[s] for s in active)
        for s in active:
            got[s] += step * weights[s] / total
        now += step
        for s in active:
            if abs(got[s] - 1) < step * weights[s] / total:
                assert abs(time(1 / weights[s]) - now) < 0.01
    assert abs(time(max(n / w for n, w in zip(blocks, weights, strict=True))) - sum(blocks)) < 1e-6


def test_mixture_of_many_sources(spark):
    """Sources are a table: 5,000 of them, one with a third of the rows."""
    frame = spark.range(15_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 5000)) as source")
    got = mixing.mix_positions(frame).agg({"mix_position": "max", "doc_id": "count"}).first()
    assert sorted(got) == [14_999, 15_000]


def test_mixture_deviates_by_less_than_a_block(spark):
    sources = ["a"] * 300 + ["b"] * 90 + ["c"] * 60 + [None] * 10
    rows = [(i, f"t{i}", s, "clash") for i, s in enumerate(sources)] + [(None, None, "a", "clash"), (5, "t5", "a", "clash")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_first string").withColumnRenamed("mix_first", "first")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    placed = sorted(mixing.mix_positions(frame, weights).collect(), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in placed] == list(range(len(rows)))
    for n in range(1, 250):  # until the first source is used up
        head = [r["source"] for r in placed[:n]]
        assert all(abs(head.count(s) - w * n) < 1 for s, w in weights.items())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in placed) == sorted((r[0] is None, r[0] or 0) for r in rows)
    mixed = mixing.mix(frame, weights)
    assert mixed.columns == frame.columns and [r["doc_id"] for r in mixed.collect()] == [r["doc_id"] for r in placed]
    assert mixing.mix(spark.createDataFrame([], frame.schema)).collect() == []
