import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, fingerprints, language_id, quality, url_filters

# Components


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3), (7, None), (100, 139), (100, 101)]
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in want:
                    want[x] = n
                    stack += near[x]
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert dict(map(tuple, components.connected_components(frame).collect())) == want
    label = components.connected_components(frame.limit(20)).where("node <> component")
    merged = dict(map(tuple, components.merged(label, frame, "src", "dst").collect()))
    assert {n: merged.get(n, n) for n in want} == want
    assert components.connected_components(frame.limit(0)).collect() == []


def test_chased_follows_parents_to_the_root(spark):
    frame = spark.createDataFrame([(i, i - 1) for i in range(1, 30)] + [(50, 40)], "node long, parent long")
    assert dict(map(tuple, components.chased(frame).collect())) == {i: 0 for i in range(1, 30)} | {50: 40}


# URL filters


def ruled(host, path, rules):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://A.example.NET/en/1", "https://x.example.net/de/1", "http://example.com/de", "http://example.com/de/", "http://m.example.com/de/x?utm_source=f", "http://example.org/fr/1", "http://example.org/en/1",
    "no scheme", None, "http://", "http://host.org?x=1", "http://host.org#y", "x://y://z/de/", "http://evil.net", "http://evil.net/", "http://notnet/", "http://h.org/a/", "http://h.org/a?ref=1", "http://h.org/a#z", "//h.org/a",
]


def test_own_rules_equal_brute_force(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], None)]
    got = [r for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filters.RULES).collect()]
    assert len(got) == len(rows)
    for r in got:
        url = URLS[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = rest
        for stop in "/?#":
            host = host.split(stop, 1)[0]
        path = rest[len(host) :]
        for stop in "?#":
            path = path.split(stop, 1)[0]
        rule, verdict = ruled(host.lower(), path, url_filters.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    by_id = {r["page_id"]: r["verdict"] for r in got}
    assert by_id[2] == "block" and by_id[13] == "block"  # aliases of example.com/de/ and of evil.net/
    assert by_id[16] == by_id[17] == by_id[8] == "allow"
    many = [(f"h{i}.test", "/", "block") for i in range(300)] + url_filters.RULES
    joined = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), many).collect()
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in joined} == {(r["page_id"], r["rule"], r["verdict"]) for r in got}


def test_blocks_spread_over_declared_links_and_allows_take_precedence(spark):
    pages = [
        (1, "http://a.org/x", '<link href="http://bad.net/p" rel="canonical">'), (2, "http://b.org/x", '<META http-equiv=refresh content="0; url=http://a.org/x">'), (3, "http://c.org/x", None),
        (4, "http://d.org/y", "<link rel=canonical href='http://e.net/q'>"), (5, "http://f.org/fr/z", "<link rel=canonical href='http://e.net/q'>"), (6, "http://g.org/r", '<link rel="canonical" href="/de/">'), (7, "http://i.org/s", None), (None, None, None),
    ]
    redirects = spark.createDataFrame([("http://i.org/s", "http://j.net/"), (None, "http://k.net/")], "src_url string, dst_url string")
    got = {r["page_id"]: (r["verdict"], r["via_alias"]) for r in url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), url_filters.RULES, redirects).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("allow", False), 6: ("allow", False), 7: ("block", True), None: ("allow", False)}
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), url_filters.RULES).collect() == []
    both = [("bad.net", "/", "block"), ("bad.net", "/", "allow")]
    for rules in (both, both[::-1], both + [(f"h{i}.test", "/", "block") for i in range(300)]):
        assert {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(spark.createDataFrame([(1, "http://bad.net/p", None)], "page_id long, url string, html string"), rules).collect()} == {1: "allow"}


REFERENCES = ["../de/q.html", "main.html", "?x=1", "/a/./b/../c", "//Other.org/z", "http://k.net/p?a=1&b=2#f", "#top", "mailto:a@b.c", "../../../up", "./", "..", "d/e/", "x?y=/../z", "", "g;p=1", ".x"]


def test_references_are_resolved_as_the_standard_says(spark):
    from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

    bases = ["http://example.com/en/p.html", "https://h.org", "http://h.org/a/b/?q=1/2", "http://h.org/a/b/c"]
    rows = [(i, r, b) for i, (r, b) in enumerate(itertools.product(REFERENCES, bases))]
    got = {x["i"]: x["to"] for x in url_filters.resolved(spark.createDataFrame(rows, "i int, ref string, base string"), "ref", "base", "to").collect()}
    for i, ref, base in rows:
        want = urldefrag(urljoin(base, ref))[0] if urldefrag(ref)[0] and not ref.startswith("mailto:") else None
        if want and urlsplit(want).path == "":
            want = urlunsplit(urlsplit(want)._replace(path="/"))
        assert got[i] == want, (ref, base)


def test_blocks_spread_over_relative_links(spark):
    """The verdicts of linked pages against union-find over links that Python's own library resolves."""
    pages = [
        (1, "http://example.com/en/p.html", "<link rel=canonical href='../de/q.html'>"), (2, "http://foo.com/a", '<link rel="canonical" href="http://bar.com/?x=1&amp;y=2">'), (3, "http://bar.com/?x=1&y=2", "<meta http-equiv='refresh' content=\"0; URL='http://evil.net/'\">"),
        (4, "http://b.org/x/y", "<base href='http://evil.net/en/'><link rel=canonical href=z>"), (5, "http://b.org/x/z", "<link rel=canonical href='#top'>"), (6, "http://c.org/k", "<link href=/k?ref=1 rel=canonical>"), (7, "http://d.org/1", "<link rel=canonical href=2>"), (8, "http://d.org/2", "<link rel=canonical href='//example.net/en/ok'>"), (9, "http://d.org/3", "<link rel=canonical href=1><link rel=canonical href=//x.net/>"),
    ]
    got = {r["page_id"]: (r["verdict"], r["via_alias"]) for r in url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), url_filters.RULES).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("block", True), 4: ("block", True), 5: ("allow", False), 6: ("allow", False), 7: ("allow", False), 8: ("allow", False), 9: ("allow", False)}


# Fingerprints


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_follow_the_contract(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.choice([1, 4, 30, 300]))) for _ in range(60)]
    texts += [texts[5], None, "", " \n ", "é𝄞日", "x" * 40_000 + " end", texts[7] + " tail"]
    ids = [3 * i - 50 for i in range(len(texts))]
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    order = sorted(ids, reverse=True)
    by_id, edits, errors = {i: t or "" for i, t in rows}, {}, []
    for n, i in enumerate(order):
        text, after = by_id[i], by_id[order[(n + 1) % len(order)]]
        h = len(text) // 2
        edits[i] = text[: len(text) - h] + after[:h]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edits[i].encode()).hexdigest())
        errors.append(r["near_edited"] - (jaccard(text, edits[i]) if text.split() or edits[i].split() else 1))
        if text.split() and after.split():
            errors.append(r["near_next"] - jaccard(text, after))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    prints = {}
    for i in ids:
        prints.setdefault(by_id[i], set()).add(got[i]["fingerprint"])
        prints.setdefault(edits[i], set()).add(got[i]["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert got[ids[texts.index("")]]["fingerprint"] == ""


def test_fingerprints_of_odd_rows(spark):
    schema = "doc_id long, text string, n string"
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], schema)).collect() == []
    (alone,) = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcd", "z")], schema)).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1
    rows = [(1, "a b", "z"), (1, "a b", "z"), (1, "a b", "y"), (1, "x yz", "z"), (None, "c d", "z"), (None, "c d", "z"), (2, None, None)]
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, schema)).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(rows) and (2, 0, sha("")) in got
    one = sorted(h for i, n, h in got if i == 1 and n == 3)  # two are followed by their like, one by the other text or null
    assert one.count(sha("a a")) == 2 and (set(one) - {sha("a a")}) <= {sha("a x"), sha("a c")} and len(one) == 3
    assert [h for i, n, h in got if i == 1 and n == 4] in ([sha("x a ")], [sha("x c ")])
    assert sorted(h for i, _, h in got if i is None) == sorted([sha("c c"), sha("c ")])


# Quality


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([1, 4, 2, 6])
    score, pair = rng.normal(size=lines.sum()) * 2, rng.normal(size=(2, 2))
    good, both, logs = quality._forward_backward(score, pair, lines)
    at = 0
    for d, n in enumerate(lines):
        total, marginal, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[at + i] for i in range(n) if labels[i]) + sum(pair[labels[i], labels[i + 1]] for i in range(n - 1)))
            total += w
            marginal += w * np.array(labels)
            for i in range(n - 1):
                pairs[labels[i], labels[i + 1]] += w
        assert np.allclose(good[at : at + n], marginal / total) and np.allclose(both[d], pairs / total) and np.isclose(logs[d], np.log(total))
        at += n


def test_line_features_are_of_each_line():
    x, length, lines = quality.line_features([b"Ab c1!\n", b"", b"go go go stop\n  \nZ"])
    assert lines.tolist() == [2, 1, 3] and length.tolist() == [6, 0, 0, 13, 2, 1]
    assert np.allclose(x[0][:7], np.array([2, 1, 1, 1, 1, 0, 0]) / 6) and x[0][12] == x[0][13] == 1 and x[1][14] == x[2][14] == 1
    assert np.isclose(x[3][15], 2 / 4) and np.isclose(x[3][16], 2 / 4) and np.isclose(np.expm1(x[3][9] * 6), 4, atol=1e-4)


def quality_rows(spark):
    rng = random.Random(2)
    good = lambda: "\n".join(" ".join(rng.choice("the of and house river walks slowly green".split()) for _ in range(12)).capitalize() + "." for _ in range(rng.randrange(1, 6)))
    bad = lambda: "\n".join(" ".join(rng.choice(["$$$", "BUY!!", "###", "NOW!!", "win%%"]) for _ in range(10)) for _ in range(rng.randrange(1, 6)))
    rows = [(i, bad() if i % 5 == 0 else good(), i % 5 != 0) for i in range(300)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int"), {i: y for i, _, y in rows}


def test_quality_of_held_out_documents(spark):
    docs, labels, truth = quality_rows(spark)
    field = quality.fit_quality(docs, labels.where("doc_id % 3 <> 1"), per_label=60)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, field).collect()}
    held = [i for i in truth if i % 3 == 1]
    assert sum((got[i] >= 0.5) == truth[i] for i in held) / len(held) > 0.97
    odd = docs.sparkSession.createDataFrame([(None, None, 1), (2, "", 1), (3, "word " * 200_000, 1), (3, "\n" * 5000, 1)], "doc_id long, text string, score long")
    rows = quality.score_quality(odd, field, marginals=True).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows) and len(rows[3]["line_marginals"]) == 5001
    assert quality.score_quality(docs.limit(0), field).collect() == []


def test_labels_of_lines_are_latent(spark):
    """Good lines inside a bad document are good: marginals follow the lines, and change inside a text."""
    docs, labels, _ = quality_rows(spark)
    rng = random.Random(8)
    good, bad = "The river walks slowly of the green house and the river walks slowly.", "$$$ BUY!! win%% NOW!! ### $$$ BUY!! win%% NOW!! ###"
    mixed = [(1000 + i, "\n".join([good] * 3 + [bad] * 3 + [good] * 3 if i % 2 else [bad] * 3 + [good] * 3 + [bad] * 3)) for i in range(60)]
    rng.shuffle(mixed)
    every = docs.union(spark.createDataFrame(mixed, "doc_id long, text string"))
    known = labels.union(spark.createDataFrame([(i, i % 2) for i, _ in mixed], "doc_id long, quality int"))
    field = quality.fit_quality(every, known)
    rows = quality.score_quality(every.where("doc_id >= 1000"), field, marginals=True).collect()
    for r in rows:
        found = [x >= 0.5 for x in r["line_marginals"]]
        want = [True] * 3 + [False] * 3 + [True] * 3 if r["doc_id"] % 2 else [False] * 3 + [True] * 3 + [False] * 3
        assert found == want and max(r["line_marginals"]) - min(r["line_marginals"]) > 0.5


def test_quality_without_labels(spark):
    docs, labels, _ = quality_rows(spark)
    assert {round(r["score"], 6) for r in quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    only_good = quality.fit_quality(docs, labels.where("quality = 1"))
    assert all(r["score"] > 0.9 for r in quality.score_quality(docs, only_good).collect())


# Language

WORDS = {"en": "the and house which through water thing with ring".split(), "de": "der und haus welche durch wasser schön straße mit".split(), "fr": "le et maison quelle été eau avec où garçon".split()}


def language_rows():
    rng = random.Random(6)
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([1, 5, 80]))), lang, f"{lang}.example.org" if i % 2 else "mixed.example.com"))
    return rows


def test_languages_are_told_from_text_whatever_is_declared(spark):
    rows = language_rows()
    wrong = {7, 8, 9}
    shown = [(i, t if i not in wrong else " ".join(WORDS["de"] * 6), "fr" if i in wrong else x, s, 0) for i, t, x, s in rows]
    more = [(900, None, "en", None, 0), (901, "", None, "en.example.org", 0), (902, "12345 !!! 678", "de", "x", 0), (903, "🙂" * 50, None, None, 0), (1, shown[1][1], "en" if shown[1][2] == "en" else shown[1][2], shown[1][3], 0)]
    docs = spark.createDataFrame(shown + more, "doc_id long, text string, lang string, source string, posterior int")
    got = language_id.identify_documents(docs).collect()
    assert len(got) == len(shown) + len(more)
    by_id = {r["doc_id"]: r for r in got}
    truth = {i: ("de" if i in wrong else x) for i, _, x, _ in rows}
    assert sum(by_id[i]["lang"] == x for i, x in truth.items()) / len(truth) > 0.98 and all(by_id[i]["lang"] == "de" for i in wrong)
    assert all(by_id[i]["accepted"] for i in truth)
    assert not any(by_id[i]["accepted"] for i in (900, 901, 902)) and by_id[900]["lang"] == "en"
    assert language_id.identify_documents(docs.limit(0)).collect() == []


def test_likelihoods_equal_brute_force(spark):
    rows = [(i, t, x, s) for i, t, x, s in language_rows()]
    base = spark.createDataFrame([(t, x) for _, t, x, _ in rows], "text string, declared string")
    model = language_id.fit_text(base)
    assert model.languages == ["de", "en", "fr", "und"]

    def grams(t):
        g, _ = language_id._letters([t.encode()])
        return g[g >= 0]

    together, bounds = language_id._letters([t.encode() for _, t, _, _ in rows])
    for n, (_, t, _, _) in enumerate(rows):
        part = together[bounds[n] : bounds[n + 1]]
        assert part[part >= 0].tolist() == grams(t).tolist()
    counts = {x: np.zeros(1 << language_id.BITS) for x in WORDS}
    for t, x in {(t, x) for _, t, x, _ in rows}:
        counts[x] += np.bincount(grams(t), minlength=1 << language_id.BITS)
    for c, x in enumerate(model.languages[:-1]):
        p = counts[x] + language_id.TRIGRAM_COUNT
        assert np.allclose(model.log_p[:, c], np.log(p / p.sum()), atol=1e-4)


def test_pages_use_markup_and_address(spark):
    rng = random.Random(3)
    pages = []
    for i in range(120):
        lang = rng.choice(list(WORDS))
        body = " ".join(rng.choice(WORDS[lang]) for _ in range(60))
        pages.append((i, f"http://www.host{i % 7}.{lang}/x", f'<html lang="{lang}-XX"><script>var the = "and";</script><p>{body}</p></html>', lang))
    frame = spark.createDataFrame([p[:3] for p in pages] + [(500, "http://www.new.de/x", '<html lang=de><p>ein</p></html>'), (501, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in language_id.identify_pages(frame).collect()}
    assert all(got[i]["lang"] == x for i, _, _, x in pages) and got[500]["lang"] == "de" and not got[501]["accepted"]


def test_fused_posteriors_equal_brute_force(spark):
    """Every piece of evidence by hand: likelihoods, declared language, suffix, and host priors that borrow from domain and all rows."""
    rng = random.Random(12)
    pages = []
    for i in range(150):
        lang = rng.choice(list(WORDS))
        said = rng.choice([lang, lang, "en", None])
        url = rng.choice([f"http://www.a{i % 3}.{lang}/x", f"http://b.c{i % 2}.com/{i}", f"http://single{i % 2}/y", None])
        body = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([0, 2, 5, 40])))
        pages.append((i, url, (f'<html lang="{said}">' if said else "<html>") + f"<p>{body}</p></html>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    base = frame.select(language_id.visible_text(F.col("html")).alias("text"), language_id.markup_language(F.col("html")).alias("declared"))
    model = language_id.fit_text(base)
    seen = []
    for i, url, html in pages:
        text = html.split("<p>")[1].split("</p>")[0]
        grams, _ = language_id._letters([f"  {text}  ".encode()])
        used = grams[grams >= 0]
        logs = model.log_p[used].astype(float).sum(axis=0) / (1 + len(used) / language_id.INDEPENDENT)
        prior = np.array([0.0] * (len(model.languages) - 1) + [np.log(language_id.UNKNOWN_PRIOR)])
        told = html.split('lang="')[1][:2] if 'lang="' in html else None
        host = url.split("://")[1].split("/")[0] if url else None
        labels = host.split(".") if host else []
        seen.append((i, logs, int((logs + prior).argmax()) if len(used) else None, told, labels[-1] if len(labels) > 1 else None, host, ".".join(labels[-2:]) if host else None))
    n = len(model.languages)
    count = lambda at, value: np.array([sum(r[2] == k and r[at] == value for r in seen) for k in range(n)], float)
    total = np.array([sum(r[2] == k for r in seen) for k in range(n)], float)
    share = (total + language_id.EVIDENCE_COUNT) / (total + language_id.EVIDENCE_COUNT).sum()
    got = {r["page_id"]: r for r in language_id.identify_pages(frame, model).collect()}
    assert len(got) == len(pages)
    for i, logs, _, told, suffix, host, domain in seen:
        score = logs.copy()
        for at, value in ((3, told), (4, suffix)):
            c = count(at, value)
            if value is not None and c.sum():
                score += np.log((c + language_id.EVIDENCE_COUNT) / (total + 20 * language_id.EVIDENCE_COUNT))
        c, d = count(5, host), count(6, domain)
        if host is not None and c.sum():
            above = (d + language_id.PARENT_COUNT * share) / (d.sum() + language_id.PARENT_COUNT)
            score += np.log((c + language_id.PARENT_COUNT * above) / (c.sum() + language_id.PARENT_COUNT))
        else:
            score += np.log(share)
        posterior = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert np.isclose(got[i]["posterior"], posterior.max(), atol=1e-4), i
        assert got[i]["lang"] == model.languages[int(posterior.argmax())] or np.isclose(*sorted(posterior)[-2:], atol=1e-4)
