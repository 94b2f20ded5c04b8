"""The operators on small tables against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomlog.llm import codec, decontaminate, embed_dedup, language_id, licences, near_dedup, packing, quality, sharding, tokenfile, tokens, url_filter
from loomlog.llm.common import Scratch, components
from loomlog.llm.queries import ORACLES, QUERIES, URL_RULES
from loomlog.llm.textbytes import column_bytes, words
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, rep string, score string, part string, key string, row string"
VOCABULARY = ["the", "of", "and", "river", "stone", "light", "Über", "été", "casa", "night", "green", "seven", "walk", "under", "paper", "glass", "train", "cloud"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", "a", "ing", "ed", "ly", "."]) for _ in range(n))


def rows(texts, start=0):
    return [(start + i, t, ["en", "de", None][i % 3], "s", 1, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]


BASE = prose(120, 1)
TEXTS = [None, "", " \n\t", "one", "one", "two words", "Two  WORDS", BASE, BASE, BASE + " end", BASE.replace("river", "lake", 1), prose(120, 2), prose(60_000, 3), "***!!! 123", "a" * 5000, "ß é\u00a0x\u2003y", "nul\x00l", prose(5, 4)]


@pytest.fixture(scope="module")
def docs(spark):
    given = rows(TEXTS)
    given.append((7, BASE, "en", "s", 1, *["y"] * 6))  # a repeated row
    given.append((None, BASE, "en", "s", 1, *["y"] * 6))
    return spark.createDataFrame(given, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(sets, percent):
    ids, root = sorted(sets), {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def word_sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, n):
    got = near_dedup.near_duplicates(docs, n_words=n).collect()
    assert len(got) == len(TEXTS) + 2
    sets = {i: word_sets(t, n) for i, t in enumerate(TEXTS)}
    want = brute_components(sets, 80)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            d = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), want[d], want[d] == d)


def test_near_duplicates_of_a_group_with_links_that_miss_its_smallest(spark):
    """A chain: neighbours are near, ends are not; and many variants around the limit."""
    base, texts = [f"w{k}" for k in range(200)], []
    for k in range(60):
        texts.append(" ".join([f"x{j}" if j < 7 * k // 2 else w for j, w in enumerate(base)]))
    r = random.Random(9)
    for _ in range(120):
        texts.append(" ".join(f"y{r.randrange(10**6)}" if r.random() < 0.06 else w for w in base))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_words=2).collect()}
    assert got == brute_components({i: word_sets(t, 2) for i, t in enumerate(texts)}, 80)


def test_near_duplicates_whose_buckets_have_smallest_documents_unlike_them(spark):
    """In each band, a document of only the words that give its registers comes first."""
    names = [f"w{k}" for k in range(108)]
    a, b = names[:100], names[8:]
    hashes = near_dedup.shingles(words(*column_bytes(pa.array([" ".join(names)])))[0], 1)
    named = {int(near_dedup.shingles(words(*column_bytes(pa.array([w])))[0], 1)[0]): w for w in names}
    assert len(named) == len(hashes) == 108
    order = (hashes[None, :] * near_dedup.MUL[: near_dedup.K, None] + near_dedup.ADD[: near_dedup.K, None]).argmin(axis=1).reshape(near_dedup.BANDS, near_dedup.ROWS)
    texts = [" ".join(sorted({named[int(hashes[k])] for k in band})) for band in order] + [" ".join(a), " ".join(b)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_words=1).collect()}
    want = brute_components({i: word_sets(t, 1) for i, t in enumerate(texts)}, 80)
    assert want[near_dedup.BANDS + 1] == near_dedup.BANDS and got == want


@pytest.mark.parametrize("share", [0.5, 0.86])
def test_texts_of_a_family_that_is_not_quite_near_are_not_compared_in_pairs(spark, monkeypatch, share):
    """Documents of one template at a similarity of about 0.5 (few meet in a band) and 0.76 (nearly all do) without a link, but for a few pairs."""
    rows_ = {}

    class Counting(Scratch):
        def write(self, df, name):
            out = super().write(df, name)
            rows_[name] = out.count()
            return out

    monkeypatch.setattr(near_dedup, "Scratch", Counting)
    r, base = random.Random(3), [f"w{k}" for k in range(300)]
    n = 700
    texts = [" ".join([w if k < 300 * share else f"x{t}.{k}" for k, w in enumerate(base)]) for t in range(n)]
    if share < 0.6:
        texts = [" ".join(w if r.random() < 0.9 else f"x{t}.{k}" for k, w in enumerate(base)) for t in range(n)]
    texts += [t + " more" for t in texts[:5]]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_words=2).collect()}
    assert got == brute_components({i: word_sets(t, 2) for i, t in enumerate(texts)}, 80)
    assert rows_.get("close", 0) <= n * (6 if share > 0.6 else 0.2)


def test_registers_estimate_the_similarity():
    a, b = (np.unique(near_dedup.fmix(np.arange(lo, lo + 4000, dtype=np.uint64) + np.uint64(1))) for lo in (0, 1000))
    equal = (near_dedup.registers(a) == near_dedup.registers(b)).sum()
    assert abs(near_dedup.estimate(np.array([equal]), np.array([4000]), np.array([4000]))[0] - 0.6) < 0.15


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_are_those_of_bytes(texts):
    hashes, starts, ends, at = words(*column_bytes(pa.array(texts, pa.string())))
    raw = "".join(texts).encode()
    seen = {}
    for k, t in enumerate(texts):
        w = t.encode().lower().split()
        assert [raw[s:e].lower() for s, e in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]], strict=True)] == w
        for x, h in zip(w, hashes[at[k] : at[k + 1]].tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (5, 5), (300, 100), (300, 100)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([100, 150, 200, 300], 100)}


# Language


def test_language(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    held = QUERIES["op1_language_id"](spark, str(SF)).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    model = language_id.fit(table.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (0, 1, 2, 13)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[7]["lang_pred"] in ("en", "de", "fr", "es")
    nothing = language_id.fit(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def folded(text):
    """Letters as they count to language identification, and one space for each run of others."""
    raw = bytearray(text.encode())
    for k, b in enumerate(raw):
        if b < 128:
            raw[k] = b | 0x20 if chr(b).isalpha() else 0x20
        elif 0x80 <= b <= 0x9E and b != 0x97 and k and raw[k - 1] == 0xC3:
            raw[k] = b + 0x20
    out = bytearray()
    for b in raw:
        if b != 0x20 or not out or out[-1] != 0x20:
            out.append(b)
    return bytes(out)


def gram_bins(text):
    b = folded(text)
    return {((int.from_bytes(b[k : k + n], "big") + (n << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language_id.BITS) for n in language_id.NGRAMS for k in range(len(b) - n + 1)}


def test_languages_are_those_of_the_dense_kernel(spark):
    """Kernel, landmarks and ridge from sets of n-grams, text by text; a text of several pieces among them."""
    texts = [(t["doc_id"], t["text"], t["lang"]) for t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect() if t["text"] and t["lang"]][:120]
    sets = [gram_bins(t) for _, t, _ in texts]
    flags = language_id.presence(*column_bytes(pa.array([t for _, t, _ in texts])))
    assert [set(np.flatnonzero(f).tolist()) for f in flags] == sets
    lang = np.array([x for _, _, x in texts])
    names = sorted(set(lang.tolist()))
    model = language_id.fit_arrays(flags, lang)
    each = language_id.LANDMARKS // len(names)
    marks = [sets[k] for x in names for k in np.flatnonzero(lang == x)[:each]]
    near = lambda a, b: len(a & b) / max(len(a), 1) ** 0.5 / max(len(b), 1) ** 0.5
    gram, cross = np.array([[near(a, b) for b in marks] for a in marks]), np.array([[near(a, b) for b in marks] for a in sets])
    # ridge in the coefficients of landmarks: (C' W C + r (G + jitter)) c = C' W y, where the jitter stands for eigenvalues under 1e-3
    w, v = np.linalg.eigh(gram)
    kept = (v * np.maximum(w, 1e-3)) @ v.T
    weight = np.array([1 / (lang == x).sum() for x in lang])
    y = np.where(lang[:, None] == np.array(names)[None, :], 1.0, -1.0)
    c = np.linalg.solve(cross.T @ (cross * weight[:, None]) + language_id.RIDGE / len(names) * kept, cross.T @ (y * weight[:, None]))
    want = [names[k] for k in (cross @ c).argmax(axis=1)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame(texts, "doc_id long, text string, lang string"), model).collect()}
    assert np.allclose(cross @ c, cross @ model.coefficients, atol=1e-4) and [got[d] for d, _, _ in texts] == want


def test_long_texts_in_pieces_give_the_same_flags_and_statistics(monkeypatch):
    texts = [prose(3000, 1), "", "a" + " " * 5000 + "b", "x" * 7000, "Éé ÇA!\n" * 900, prose(5, 2)]
    from loomlog.llm import textbytes

    whole = [language_id.presence(*column_bytes(pa.array(texts))), quality.statistics(*column_bytes(pa.array(texts)))]
    for piece in (64, 1000):
        for m in (language_id, quality, textbytes):
            monkeypatch.setattr(m, "PIECE", piece)
        assert np.array_equal(language_id.presence(*column_bytes(pa.array(texts))), whole[0])
        assert np.allclose(quality.statistics(*column_bytes(pa.array(texts))), whole[1])


# Urls

URLS = [None, "", "no scheme.com/en/1", "http://COM/en/", "https://a.b.com/en/x?q#f", "http://x.example.com/en/76#t", "http://example.com/en/7?x", "http://notcom/en/1", "ftp://h.net/de/8", "http://EXAMPLE.net/de/80", "http://a.example.net/de/9/", "http://q.org?x/es/", "http://q.org/es/", "http://q.org/ES/", "x://y://z/en/", "http://a\nb.com/en/1", "http://lonely.test/x"]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_urls(spark):
    html = '<a href="/x">x</a><A HREF=\'http://bad.org/es/1\'>'
    pages = spark.createDataFrame([(i, u, html if i % 2 else None, "x", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, rule string")
    for r in url_filter.judge(pages, URL_RULES).collect():
        host, path, rule = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == rule.verdict)
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    a = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    pages = [(1, "http://good.net/de/1", a("friend.io")), (2, "http://friend.io/1", a("friend.io")), (3, "http://shill.io/1", a("bad.org")), (4, "http://bad.org/es/1", a("victim.io")), (5, "http://victim.io/", ""), (6, "http://friend.shill.io/", a("shill.io"))]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block"}
    assert got[2]["trust"] > 0 and got[3]["distrust"] > got[6]["distrust"] > 0 and got[5]["trust"] == got[5]["distrust"] == 0
    assert f"t{url_filter.STEPS}" in ORACLES["op2_url_filter"]


@pytest.mark.parametrize("seed", range(2))
def test_ranks_are_those_of_the_dense_walk(spark, seed):
    """Random links with long chains and hosts without links, against matrix steps where lost rank goes back to the seeds."""
    import duckdb
    import pandas as pd

    r = random.Random(seed)
    hosts = [f"h{k}.{r.choice(['com', 'net', 'org', 'io', 'io'])}" for k in range(60)]
    n, pages, hrefs = len(hosts), [], {}
    for k, h in enumerate(hosts):
        to = [hosts[k + 1]] if k < 30 else [r.choice(hosts) for _ in range(r.randrange(4))]
        for p in range(r.randrange(1, 4)):
            pages.append((len(pages), f"http://{h}/{r.choice(['en', 'de', 'es'])}/{p}", "".join(f'<a href="http://{x}/">' for x in to)))
            hrefs.setdefault(k, []).extend(hosts.index(x) for x in to)
    rule = lambda u: brute_rule(u)[2]
    links = np.zeros((n, n))
    for k, to in hrefs.items():
        for x in to:
            links[k, x] += 1
    ranks = []
    for m, verdict in ((links, "allow"), (links.T, "block")):
        own = [[rule(u) for _, u, _ in pages if f"//{h}/" in u] for h in hosts]
        s = np.array([sum(x is not None and x.verdict == verdict for x in rs) / len(rs) for rs in own])
        s, out = s / s.sum(), m.sum(axis=1, keepdims=True)
        step, x = np.divide(m, out, where=out > 0, out=np.zeros((n, n))), s
        for _ in range(300):
            x = 0.85 * (x @ step + x[out[:, 0] == 0].sum() * s) + 0.15 * s
        ranks.append(x)
    got = {x["page_id"]: x for x in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    for p, u, _ in pages:
        k = hosts.index(brute_rule(u)[0])
        assert abs(got[p]["trust"] - ranks[0][k]) < 1e-7 and abs(got[p]["distrust"] - ranks[1][k]) < 1e-7
        assert got[p]["verdict"] == (rule(u).verdict if rule(u) else "block" if ranks[1][k] > ranks[0][k] + 1e-9 else "allow")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert {x[0]: x[4] for x in con.execute(ORACLES["op2_url_filter"]).fetchall()} == {p: x["verdict"] for p, x in got.items()}


# Sharding


def test_sharding(spark, docs, empty):
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    assert set(table) == set(range(10)) and max(np.bincount(table)) - min(np.bincount(table)) <= 1
    less = sharding.fill(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, less, strict=True)) < 0.3 * 1009  # a tenth must move
    heavy = np.bincount(sharding.fill(names, 1009, {"s3": 3}))
    assert abs(heavy[3] - 3 * heavy[0]) <= 3
    got = sharding.place(docs.withColumn("shard", F.lit(1)), "doc_id", names, 1009).collect()
    assert len(got) == len(TEXTS) + 2 and len({(r["doc_id"], r["shard"]) for r in got}) == len(TEXTS) + 1
    for r in got:
        import hashlib

        slot = int(hashlib.md5(("null" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % 1009
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.place(empty, "doc_id", names).count() == 0 and sharding.fill([]) == []
    assert sharding.place(docs, "doc_id", []).where("shard is not null").count() == 0
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def claimed(names, slots):
    """The table by whole preference lists: in each turn a shard takes the first slot of its list that nobody has."""
    import hashlib

    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:16], 16)
    lists = {s: iter([(number(f"offset:{s}") % slots + k * (number(f"skip:{s}") % (slots - 1) + 1)) % slots for k in range(slots)]) for s in names}
    owner = {}
    while len(owner) < slots:
        for s in sorted(names):
            free = next((x for x in lists[s] if x not in owner), None)
            if free is not None:
                owner[free] = s
    return [owner[k] for k in range(slots)]


def test_shards_claim_slots_in_turns():
    from loomlog.llm.queries import SHARDS

    names = [f"n{k}" for k in range(7)]
    assert [names[i] for i in sharding.fill(names, 211)] == claimed(names, 211)
    assert [sorted(SHARDS)[i] for i in sharding.fill(SHARDS, 4099)] == claimed(SHARDS, 4099)


def test_shards_are_written(spark, docs, empty, tmp_path):
    names, path = ["a", "b", "c"], str(tmp_path / "shards")
    hot = docs.unionByName(spark.createDataFrame(rows([prose(3, k) for k in range(300)]), DOCS).withColumn("doc_id", F.lit(7).cast("long")))
    sharding.write_shards(hot, "doc_id", names, path, files_per_shard=4, slots=1009)
    back = spark.read.parquet(path)
    want = sharding.place(hot, "doc_id", names, 1009)
    assert sorted(map(str, back.select("doc_id", "text", "slot", "shard").collect())) == sorted(map(str, want.select("doc_id", "text", "slot", "shard").collect()))
    files = back.select("shard", F.input_file_name().alias("f")).distinct().groupBy("shard").count().collect()
    assert max(r["count"] for r in files) == 4
    sharding.write_shards(empty, "doc_id", names, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sharding.write_shards(docs, "doc_id", [], str(tmp_path / "no"))


# Benchmark items


def test_decontamination(spark, docs, empty):
    items = [(i, prose(40, 100 + i) + f" the answer is {i} of course.") for i in range(12)] + [(50, None), (51, " . "), (52, prose(12, 300))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pad = lambda k: prose(150, 500 + k)
    texts = [f"{pad(k)} {items[k][1]} {pad(k + 50)}" if k < 12 else pad(k) for k in range(40)]
    swapped = items[2][1].split()
    swapped[5], swapped[20] = "other", "word"
    texts += [f"{pad(90)}\n{' '.join(swapped).upper()}\n{pad(91)}", items[3][1], f"{prose(150_000, 900)} {items[4][1]} {pad(92)}", " ".join(f"{w}***" for w in items[12 + 2][1].split()), None, ""]
    table = spark.createDataFrame([*rows(texts)], DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()}
    want = {(k, k) for k in range(12)} | {(40, 2), (41, 3), (42, 4), (43, 52)}
    assert got == want
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(empty, bench).count() == 0
    decontaminate.leaks(docs, bench).count()


def test_decontamination_of_items_of_frequent_words_only(spark):
    """Words in most passages have no weight in the latent space; the rest of the vocabulary is a long tail."""
    r = random.Random(6)
    often = [f"often{k}" for k in range(60)]
    text = lambda n: " ".join(r.choice(often) if r.random() < 0.9 else f"seldom{r.randrange(5000)}" for _ in range(n))
    items = [(k, " ".join(r.choice(often) for _ in range(30))) for k in range(8)] + [(8, " ".join(["often1 often2"] * 15))]
    texts = [f"{text(150)} {items[k][1]} {text(70)}" if k < 9 else text(300) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(table, bench).where("share = 1").collect()}
    assert got == {(k, k) for k in range(9)}


def brute_leaks(texts, items):
    """All windows of all documents against all items, by the longest common subsequence alone."""
    column = lambda x: words(*column_bytes(pa.array([(t or "").lower() for t in x], pa.string())), decontaminate.ALNUM)
    hashes, _, _, at = column(texts)
    given = decontaminate.prepare([(k, (t or "").lower()) for k, t in enumerate(items)], np.zeros((decontaminate.TERMS, 4)), np.zeros(decontaminate.TERMS))
    found, step = set(), decontaminate.STRIDE
    for d in range(len(texts)):
        own = hashes[at[d] : at[d + 1]].tolist()
        for j, item in enumerate(given.words):
            if len(set(item) & set(own)) < 0.2 * len(set(item)):
                continue
            steps = int(given.steps[j])
            for s in range(-(-len(own) // step)):
                window = own[max(s - 1, 0) * step : (s + steps + 1) * step]
                share = decontaminate._subsequence(item, window) / len(item)
                n = given.answer[j]
                if share >= decontaminate.ITEM or share >= decontaminate.PART and decontaminate._subsequence(item, window, len(item) - n) / n >= decontaminate.ANSWER:
                    found.add((d, given.ids[j]))
                    break
    return found


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_leaks_are_those_of_all_windows_and_items(spark, sf):
    docs_ = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    some = docs_.where("doc_id % 20 = 0" if sf == "0.01" else "true").select("doc_id", "text").orderBy("doc_id").collect()
    items = spark.read.parquet(f"/root/testdata/sf{sf}/benchmark.parquet").orderBy("item_id").collect()
    want = {(some[d]["doc_id"], items[j]["item_id"]) for d, j in brute_leaks([r["text"] for r in some], [r["text"] for r in items])}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"](spark, f"/root/testdata/sf{sf}").collect()}
    assert want and {x for x in got if sf == "0.001" or x[0] % 20 == 0} == want


def test_more_items_than_a_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    items = [(k, prose(30, 700 + k)) for k in range(8)]
    texts = [f"{prose(60, 800 + k)} {items[k][1]}" for k in range(8)]
    got = decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, k) for k in range(8)}


def test_longest_common_subsequence():
    r = random.Random(2)

    def table(a, b):
        rows_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows_[i + 1][j + 1] = rows_[i][j] + 1 if x == y else max(rows_[i][j + 1], rows_[i + 1][j])
        return rows_[-1][-1]

    for _ in range(100):
        a, b = tuple(r.randrange(5) for _ in range(r.randrange(1, 90))), [r.randrange(6) for _ in range(r.randrange(80))]
        assert decontaminate._subsequence(a, b) == table(a, b)


# Quality


def test_quality(spark, docs, empty):
    scored = QUERIES["op6_quality_classifier"](spark, str(SF)).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.9 and scored["score"].between(0, 1).all()
    stats = quality.document_statistics(docs)
    labels = spark.createDataFrame([(7, 1), (7, 1), (13, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    got = quality.score(stats, model).toPandas()
    assert len(got) == len(TEXTS) + 2 and got["score"].between(0, 1).all()
    assert set(quality.score(stats, quality.fit(stats, labels.limit(0))).toPandas()["score"]) == {0.5}
    assert quality.score(quality.document_statistics(empty), model).count() == 0


def test_quality_scores_are_those_of_dense_equations(spark):
    """The ridge on all features in one piece, and isotonic levels by means of all runs of bins."""
    docs_ = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    stats = quality.document_statistics(docs_).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    all_ = {r["doc_id"]: (np.frombuffer(bytes(r["stats"]), np.float32).astype(float), r["fold"]) for r in stats.collect()}
    given = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in all_}
    ids = sorted(given)
    x, fold, y = np.array([all_[d][0] for d in ids]), np.array([all_[d][1] for d in ids]), np.array([given[d] for d in ids], float)
    scale = x.std(axis=0)
    mean, scale = x.mean(axis=0), np.where(scale > 1e-6, scale, 1.0)
    z, own = quality.fourier(x, mean, scale), fold != quality.CALIBRATE
    weights = np.linalg.solve(z[own].T @ z[own] + quality.RIDGE * len(x) / z.shape[1] * np.eye(z.shape[1]), z[own].T @ y[own])
    bins = np.floor(np.clip(z[~own] @ weights, -0.5, 1.5) * quality.BINS / 2).astype(int)
    at = sorted(set(bins.tolist()))
    mean_of = lambda lo, hi: y[~own][(bins >= at[lo]) & (bins <= at[hi])].mean()
    level = [max(min(mean_of(lo, hi) for hi in range(k, len(at))) for lo in range(k + 1)) for k in range(len(at))]
    model = quality.fit(stats.drop("fold"), labels)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale, rtol=1e-5) and np.allclose(z @ model.weights, z @ weights, atol=1e-4)
    assert np.allclose(sorted(set(np.round(level, 9))), model.values, atol=1e-6)


def test_pool_adjacent_is_monotone_and_keeps_the_mean():
    r = np.random.default_rng(1)
    v, w = r.normal(size=50), r.uniform(0.5, 2, 50)
    p = quality.pool_adjacent(v, w)
    assert (np.diff(p) >= -1e-12).all() and abs((p * w).sum() - (v * w).sum()) < 1e-9 and np.allclose(quality.pool_adjacent(p, w), p)


# Tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab Z09,.!?'\"*\n\t_é×ß\u00a0日\x00|&")) | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_cut_texts_give_the_library_ids(texts):
    ids, at = tokens.encoder().encode(*column_bytes(pa.array(texts, pa.string())), 9)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [[*ids_of(t), 9] for t in texts]


def test_long_texts_are_cut_into_parts_and_the_cache_is_bounded(monkeypatch):
    r = random.Random(5)
    words_ = [" the", " of", "  two", "\n", " don't", " Über", " 日本", "\u00a0x", " a1b2", "...", " abcdefghijklmnopqrstuvwxyz", "\x00"] + [f" {chr(97 + a)}{chr(97 + b)}x" for a in range(26) for b in range(26)]
    texts = ["".join(r.choice(words_) for _ in range(n)) for n in (3000, 0, 1, 2000, 5)]
    for part, pieces in ((1000, 1 << 20), (5, 50), (1 << 20, 100)):
        monkeypatch.setattr(tokens, "PART", part)
        monkeypatch.setattr(tokens, "PIECES", pieces)
        ids, at = tokens.encoder().encode(*column_bytes(pa.array(texts, pa.string())))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [ids_of(t) for t in texts]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=400))
def test_blocks_round_trip(ids):
    got = codec.decode(codec.encode(np.array(ids, np.uint32), 300))
    assert (np.concatenate(got).tolist() if got else []) == ids


def test_blocks_of_all_kinds_and_damage():
    r = np.random.default_rng(0)
    n = 2 * codec.BLOCK + 5000
    for ids in (np.zeros(n, np.uint32), np.arange(n, dtype=np.uint32) % 50_257, r.integers(0, 50_257, n).astype(np.uint32), r.zipf(1.2, n).clip(0, 50_256).astype(np.uint32)):
        blocks = codec.encode(ids, 50_257)
        assert len(blocks) == -(-len(ids) // codec.BLOCK) and np.array_equal(np.concatenate(codec.decode(blocks)), ids)
        assert np.array_equal(codec.decode(blocks[1:2])[0], ids[codec.BLOCK : 2 * codec.BLOCK])  # each block on its own
    assert all(np.array_equal(codec.decode(codec.encode(x, 1 << 20))[0], x) for k in (1, 2, 255, 256, 257, 3000) for x in [r.integers(0, 1 << 20, k).astype(np.uint32)])
    bad = bytearray(blocks[0])
    bad[len(bad) // 2] ^= 4
    for x in (bytes(bad), blocks[0][:-2], b"", b"XXXX" + blocks[0][4:]):
        with pytest.raises(codec.Corrupt):
            codec.decode([x])
    with pytest.raises(ValueError):
        codec.encode(np.array([300], np.uint32), 300)


def test_token_files(spark, docs, empty, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write(docs, path)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.digests(spark, path).collect())
    want, at = [], 0
    for d, t in [(-1, BASE), *sorted([*enumerate(TEXTS), (7, BASE)], key=lambda x: x[0])]:
        ids = [*ids_of(t), 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    tokenfile.export(spark, path, str(tmp_path / "one.lmc"))
    assert len(tokenfile.import_file(str(tmp_path / "one.lmc"))) == at
    tokenfile.write(empty, str(tmp_path / "none"))
    assert tokenfile.digests(spark, str(tmp_path / "none")).count() == 0


# Packing


def check_packed(got, docs_):
    want = {}
    for d, t in docs_:
        ids = [*ids_of(t), 2]
        start = 0
        for k, end in enumerate(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)):
            want[d, k] = (start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()))
            start = end
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == list(np.cumsum([0, *(n for _, n in x[:-1])])) and sum(n for _, n in x) <= 1024
    return len(places), -(-sum(r["length"] for r in got) // 1024)


def test_packing(spark, docs, empty):
    got = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    used, least = check_packed(got, list(enumerate(TEXTS)))
    assert used <= least + 1
    assert packing.pack(empty).count() == 0 and packing.pack(docs).count() > len(got)


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_whole_and_tight(seed):
    r = np.random.default_rng(seed)
    lengths = [r.integers(1, 1025, 3000), np.minimum(r.lognormal(5.5, 1, 20_000).astype(int) + 1, 1024), np.repeat([600, 400, 24], [900, 900, 900]), np.array([1024, 1])][seed]
    h = np.bincount(lengths, minlength=1025)
    p, fill, seen = packing.plan(h), defaultdict(int), set()
    for x in np.flatnonzero(h):
        rank = np.arange(h[x])
        k = np.searchsorted(p.rank[x], rank, "right") - 1
        extra = rank - p.rank[x][k]
        for s, o in zip((p.sequence[x][k] + extra // p.copies[x][k]).tolist(), (p.offset[x][k] + extra % p.copies[x][k] * x).tolist(), strict=True):
            assert (s, o) not in seen
            seen.add((s, o))
            fill[s] += int(x)
    assert max(fill.values()) <= 1024 and len(fill) == p.sequences and p.sequences <= 1.02 * max(-(-lengths.sum() // 1024), (lengths > 512).sum()) + 1


# Vectors


def brute_links(rows_, cosine=0.98):
    good = [k for k, (i, v, x) in enumerate(rows_) if i is not None and x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    m = np.array([rows_[k][1] for k in good], float)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label, ids = np.array([rows_[k][2] for k in good]), np.array([rows_[k][0] for k in good])
    near = (m @ m.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    tied = near | (ids[:, None] == ids[None, :])
    comp = ids.copy()
    while (new := np.minimum(comp, np.where(tied, comp[None, :], 10**9).min(axis=1))).tolist() != comp.tolist():
        comp = new
    of = dict(zip(ids.tolist(), comp.tolist(), strict=True))
    links = dict(zip(good, near.sum(axis=1).tolist(), strict=True))
    return sorted((i, links.get(k, 0), of.get(i, i), of.get(i, i) == i) for k, (i, _, _) in enumerate(rows_) if i is not None)


def found_links(df):
    return sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in df.collect() if x["vec_id"] is not None)


VECTORS = "vec_id long, embedding array<double>, label int, rep string, v string"


def test_vectors(spark, monkeypatch):
    r = np.random.default_rng(3)
    c = r.normal(size=(30, 6))
    given = [(i, [float(x) for x in c[r.integers(30)] + 0.08 * r.normal(size=6)], int(i % 2)) for i in range(400)]
    given += [(400 + i, given[5][1], given[5][2]) for i in range(5)] + [(500, [2 * x for x in given[5][1]], given[5][2])]
    given += [(7, given[20][1], given[20][2]), (7, given[31][1], given[31][2]), (7, given[20][1], given[20][2]), (None, given[5][1], 1)]
    given += [(600, None, 1), (601, [], 1), (602, [0.0] * 6, 1), (603, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (604, [float("nan")] + [1.0] * 5, 1), (605, [float("inf")] + [1.0] * 5, 1), (606, given[5][1], None), (607, [1e200] * 6, 0), (608, [1e-200] * 6, 0), (7, None, 1)]
    table = spark.createDataFrame([(*x, "x", "x") for x in given], VECTORS)
    want = brute_links(given)
    assert found_links(embed_dedup.near_vectors(table)) == want
    for cell, salt in ((40, 100), (5, 1 << 18)):  # many cells
        monkeypatch.setattr(embed_dedup, "CELL", cell)
        monkeypatch.setattr(embed_dedup, "SALT", salt)
        assert found_links(embed_dedup.near_vectors(table)) == want
    assert embed_dedup.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.002, 0.03, 0.2])
def test_dense_groups_of_vectors(spark, monkeypatch, spread):
    """All near each other, cells of which some are wholly near, and a mixture."""
    r = np.random.default_rng(5)
    base = r.normal(size=8)
    given = [(i, (base + spread * r.normal(size=8)).tolist(), 1) for i in range(1500)]
    monkeypatch.setattr(embed_dedup, "CELL", 50)
    table = spark.createDataFrame([(*x, "x", "x") for x in given], VECTORS)
    assert found_links(embed_dedup.near_vectors(table)) == brute_links(given)


def test_a_dense_group_of_twenty_thousand(spark):
    r = np.random.default_rng(6)
    base, n = r.normal(size=8), 20_000
    given = [(i, (base + 0.001 * r.normal(size=8)).tolist(), 1) for i in range(n)]
    got = embed_dedup.near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>, label int")).toPandas()
    assert len(got) == n and set(got["n_links"]) == {n - 1} and set(got["component_id"]) == {0}


def test_repeated_vectors_of_an_id_share_its_component(spark):
    given = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.02], 1), (None, [1.0, 0.0], 1)]
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int")
    assert found_links(embed_dedup.near_vectors(table)) == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]


# Licences


def test_licences(spark, docs, empty):
    mit, apache, gpl = (licences.NOTICES[k][0] for k in ("MIT", "Apache-2.0", "GPL-3.0"))
    given = [
        (0, mit, "a/LICENSE"), (1, prose(30, 1), "a/x.py"), (2, prose(30, 2), "a/b/c/y.py"), (3, apache, "a/b/LICENSE"), (4, prose(50, 3) + "\n" + gpl + "\n" + prose(50, 4), "a/b/z.py"),
        (5, prose(9, 5), "q/r.py"), (6, None, "a/b/n.py"), (7, "", None), (8, mit, None), (9, prose(20, 6), "top.py"), (10, "LICENSED UNDER CC by-nc 4.0", "a/d/u.py"), (11, "licensed to nobody at all for this or that thing", "q/s.py"),
        (12, "// SPDX-License-Identifier: ISC", "y/i.c"), (13, "// SPDX-License-Identifier: Sleepycat", "q/sp.c"),
    ]
    got = {r["doc_id"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in licences.scan(spark.createDataFrame(given, "doc_id long, text string, path string")).collect()}
    assert got == {
        0: ("MIT", "MIT", None), 1: (None, "MIT", "a"), 2: (None, "Apache-2.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: ("GPL-3.0", "GPL-3.0", None), 5: (None, None, None),
        6: (None, "Apache-2.0", "a/b"), 7: (None, None, None), 8: ("MIT", "MIT", None), 9: (None, None, None), 10: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 11: (None, None, None),
        12: ("ISC", "ISC", None), 13: (None, None, None),
    }
    assert licences.scan(docs.withColumn("path", F.lit("x/y"))).count() == len(TEXTS) + 2
    assert licences.scan(empty.withColumn("path", F.lit("x"))).count() == 0


def wrapped(text, width, sign=""):
    import textwrap

    return "\n".join(sign + line for line in textwrap.wrap(text, width))


def test_licence_files_and_headers_of_real_projects(spark):
    """Whole licence texts with a title and a holder, headers wrapped as comments, and one inside a long line."""
    head = lambda name: f"{name}\n\nCopyright (c) 2019 Some Body and others\n\n"
    texts = {k: v[0] for k, v in licences.TEXTS.items()}
    rest = {"GPL-3.0": 5000, "GPL-2.0": 2500, "LGPL-2.1": 4000, "LGPL-3.0": 900, "AGPL-3.0": 5000, "Apache-2.0": 1500, "MPL-2.0": 2200, "CC0-1.0": 900, "CC-BY-4.0": 2000, "CC-BY-SA-4.0": 2000, "CC-BY-NC-4.0": 2000}
    given, want = [], {}
    for k, (name, text) in enumerate(sorted(texts.items())):
        given += [(2 * k, head(name) + wrapped(text, 70) + "\n" + prose(rest.get(name, 0), k), f"p{k}/LICENSE"), (2 * k + 1, prose(40, 50 + k), f"p{k}/src/a.py")]
        want |= {2 * k: (name, True, name), 2 * k + 1: (None, False, name)}
    at = 2 * len(texts)
    for name, notices in sorted(licences.NOTICES.items()):
        for notice in notices[:2]:
            given += [(at, wrapped(notice, 38, "# ") + "\n\n" + prose(90, at), f"q/{at}.py"), (at + 1, f"{prose(70, at + 1)} {notice} {prose(70, at + 2)}", f"q/{at}b.py")]
            want |= {at: (name, False, name), at + 1: (name, False, name)}
            at += 2
    given.append((at, f"{licences.NOTICES['MIT'][0]}\n{prose(30, 9)}", "z/COPYING.txt"))
    want[at] = ("MIT", True, "MIT")
    got = {r["doc_id"]: (r["own_licence"], r["licence_file"], r["licence"]) for r in licences.scan(spark.createDataFrame(given, "doc_id long, text string, path string")).collect()}
    assert got == want


def test_licence_scores_are_those_of_dense_vectors(spark):
    """All passages of each text against all templates, with words as text and without anchors."""
    import re
    from math import log, sqrt

    notices = {"A-1": ("licensed under the river licence 1", "see the stone file for terms"), "B": ("the night light licence b applies to all of this",)}
    texts = {"A-1": ("river terms and conditions of the paper walk under glass seven times the green train",)}
    rows_ = [(k, t) for given in (notices, texts) for k in sorted(given) for t in given[k]]
    r = random.Random(4)
    pieces = [t for _, t in rows_] + ["river", "the", "licence", "terms of the night", "zebra", "under the river licence"]
    docs_ = ["\n".join(" ".join(r.choice(pieces) if r.random() < 0.4 else r.choice(VOCABULARY) for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(0, 5))) for _ in range(60)]
    lower = lambda ws: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
    split = lambda t: lower(re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t))
    known = {w for _, t in rows_ for w in split(t)}
    lines = [split(x) for d in docs_ for x in d.split("\n") if x]
    idf = {w: log((1 + len(lines)) / (1 + sum(w in x for x in lines))) + 1 for w in known}
    rest = log(1 + len(lines)) + 1

    def cosine(passage, template):
        x, v = ({w: (1 + log(ws.count(w))) * idf[w] for w in set(ws) & known} for ws in (passage, template))
        other = sum(w not in known for w in passage)
        norm = sqrt(sum(c * c for c in x.values()) + other * rest**2) * sqrt(sum(c * c for c in v.values()))
        return sum(x[w] * v.get(w, 0) for w in x) / max(norm, 1e-12)

    best = []
    for d in docs_:
        ws, top = split(d), 0.0
        for name, t in rows_:
            own = split(t)
            needed = set() if t in texts.get(name, ()) else set(split(name)) & set(own)
            spans = [ws, *(split(x) for x in d.split("\n"))]
            spans += [ws[max(p - q, 0) : max(p - q + len(own), 0)] for p, w in enumerate(ws) for q, o in enumerate(own) if o == w]
            top = max([top, *(cosine(s, own) for s in spans if needed <= set(s))])
        best.append(top)
    got = {x["doc_id"]: (x["own_licence"], x["score"]) for x in licences.detect(spark.createDataFrame([(k, d, "p") for k, d in enumerate(docs_)], "doc_id long, text string, path string"), notices, texts).collect()}
    assert sum(b >= licences.THRESHOLD for b in best) > 10
    for k, b in enumerate(best):
        assert (got[k][0] is not None) == (b >= licences.THRESHOLD)
        if b >= licences.THRESHOLD:
            assert abs(got[k][1] - b) < 1e-9


# Pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    bench = spark.createDataFrame([(1, prose(40, 77))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, 1), (9, 1), (11, 1), (13, 0), (14, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    leak = prose(90, 8) + " " + prose(40, 77)
    more = docs.unionByName(spark.createDataFrame([*rows([leak, prose(99, 12)], 60), (None, leak, "en", "s", 1, *["y"] * 6), (61, prose(80, 13), "en", "s", 1, *["z"] * 6)], DOCS))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_classifier"](spark, more, str(tmp_path))
    assert kept.columns == more.columns
    kept = stages["language_id"](spark, more.withColumn("lang", F.lit(None).cast("string")), str(tmp_path))
    assert kept.columns == more.columns and {r["doc_id"] for r in kept.select("doc_id").collect()}.isdisjoint({0, 1, 2, 13})
    one = stages["minhash_near_dedup"](spark, more, str(tmp_path))
    # rows without an id, and each of a repeated id, are documents; of equal texts that with the smallest id stays
    want = brute_components({i: word_sets(t, 5) for i, t in enumerate(TEXTS)}, 80)
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert one.columns == more.columns and sorted(d for d, _ in left if d is not None and d < 60) == sorted(d for d, c in want.items() if d == c)
    assert sorted(t for d, t in left if d is not None and d >= 60) == sorted([leak, prose(99, 12), prose(80, 13)])
    assert [t for d, t in left if d is None] == []
    clean = stages["benchmark_decontamination"](spark, more, str(tmp_path))
    assert clean.columns == more.columns and clean.count() == more.count() - 2 and clean.where(F.col("text") == leak).count() == 0
    assert stages["best_fit_packing"](spark, more, str(tmp_path)).count() >= more.count()
    nothing = more.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_pipeline_stages_with_labels_drop_what_their_scores_say(spark):
    """Quality and language against the operators' scores of the same rows, one by one."""
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    stats = quality.document_statistics(docs_)
    scores = {r["doc_id"]: r["score"] for r in quality.score(stats, quality.fit(stats, labels)).collect()}
    got = {r["doc_id"] for r in corpus_pipeline.by_quality(spark, docs_, str(SF)).collect()}
    assert got == {d for d, s in scores.items() if s >= corpus_pipeline.QUALITY} and 0 < len(got) < len(scores)
    model = language_id.fit(docs_.select("doc_id", "text", "lang"))
    named = language_id.predict(docs_, model, ("doc_id", "lang")).collect()
    want = {r["doc_id"] for r in named if r["lang_pred"] != "und" and not (r["lang"] in model.languages and r["lang"] != r["lang_pred"] and r["score"] >= corpus_pipeline.LANGUAGE)}
    assert {r["doc_id"] for r in corpus_pipeline.by_language(spark, docs_, str(SF)).collect()} == want


def test_scratch_tables_go(spark, tmp_path):
    from loomlog.llm.common import scratch_of

    with scratch_of(spark):
        held = Scratch(spark)
        held.write(spark.range(3), "x")
        assert spark.read.parquet(f"{held.root}/x").count() == 3
    assert held.root not in Scratch.made
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{held.root}/x").count()


def test_pipeline_keeps_languages_that_were_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    said = [("en", "the river and the stone under the light"), ("de", "der große Zug fährt über die Brücke"), ("xx", "the stone and the river under the light")]
    texts = [(k, f"{t} {k}", lang) for n, (lang, t) in zip((30, 30, 5), said, strict=True) for k in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "").where("lang = 'xx'").count() == 5


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, str(SF)).collect()
    kept = {r["doc_id"] for r in got}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(kept))).collect()}
    check_packed(got, sorted(texts.items()))
    assert len(kept) > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    cols = [x[0] for x in con.description]
    got = QUERIES[name](spark, str(SF)).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sums_of_many_tasks(spark):
    from loomlog.llm.common import summed

    def part(batch, total):
        total += [len(batch), batch["id"].to_numpy().sum()]

    assert summed(spark.range(0, 4000, 1, 300).select("id"), part, 2).tolist() == [4000, 7998000]
    assert summed(spark.range(0).select("id"), part, 2) is None
