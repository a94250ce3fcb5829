"""Ranked search, spelling variants and WARC bundles against plain Python versions, with odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import ranked_search, spelling, warc


def plain_variants(docs, least=6, often=5, one_in=199, times=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}

    def one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def random_words(rng, letters, count, low, high):
    return ["".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(count)]


@pytest.mark.parametrize("letters,most", [("abc", 16_384), ("abc", 40), ("aeiostáéÀÿñ", 25)])
def test_spelling_like_plain_search(spark, letters, most):
    rng = np.random.default_rng(len(letters) + most)
    pool = random_words(rng, letters, 300, 6, 9) + ["aaaaaa" * 30, "aaaaaa" * 30 + "a"]
    picks = rng.zipf(1.4, 12_000) % len(pool)
    docs = [(i, " ".join(pool[p].upper() if i % 7 == 0 and pool[p].isascii() else pool[p] for p in picks[50 * i : 50 * i + 50])) for i in range(240)]
    docs += [(None, "abcabc, abcabc\nabcabc abcabc abcabc abcabc"), (3, None), (4, ""), (5, " \n"), (6, "中文 abc"), (0, docs[0][1]), (0, docs[0][1])]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, word string, n string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame, most=most).collect()}
    want = plain_variants(docs)
    assert got == want and any(v[0] for v in want.values())


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).count() == 0


def test_trie_leaf_of_many_anagrams():
    """Words with equal counts are looked up, not compared pair by pair."""
    rng = np.random.default_rng(5)
    many = sorted({"".join(rng.permutation(list("abcdefá"))).encode("latin-1") for _ in range(900)})  # á counts as a
    asked = sorted({bytes(w[:i] + w[i + 1 :]) for w in many[:40] for i in (0, 3)} | set(many[:60]))
    counts = spelling.vectors(many)
    order = np.lexsort(counts.T[::-1])
    known = [many[i] for i in order]
    got = sorted((asked[q], known[k]) for q, k in spelling.search(counts[order], known, spelling.vectors(asked), asked))
    want = sorted((a, b) for a in asked for b in known if len(b) - len(a) in (0, 1) and (len(a) < len(b) or a < b) and spelling.one_apart(a, b))
    assert got == want and len(want) > 80


ITEM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_ranks(docs, items, k=10):
    def terms(text):
        return ITEM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    tallies = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    tallies = [t for t in tallies if t[2]]
    n_docs, length, df = len(tallies), sum(t[2] for t in tallies), Counter()
    for _, tally, _ in tallies:
        df.update(tally.keys())
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc, tally, n in tallies:
            m = 25 + 75 * n * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tally[t] // (1000 * tally[t] + 8 * m)) for t, q in asked.items() if t in tally)
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("terms", [8192, 20])
def test_ranked_search_like_all_scores(spark, monkeypatch, terms):
    monkeypatch.setattr(ranked_search, "TERMS", terms)  # blocks of a few items
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(150)] + ["É9", "ñandú", "中"]
    docs = [(i, " ".join(pool[p % len(pool)] for p in rng.zipf(1.3, rng.integers(1, 80)))) for i in range(300)]
    docs += [(None, "w3 w5 w7"), (400, None), (401, ""), (402, "-- !"), (7, docs[7][1]), (8, docs[7][1]), (403, "W3,w5" * 900)]
    items = [(i, " ".join(pool[p % len(pool)] for p in rng.zipf(1.2, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (3, "w5 w5 É9"), (3, "w5 w5 É9")]
    frame = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, n int, terms string")
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in ranked_search.search(frame, asked).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain_ranks(docs, items)


def test_ranked_search_of_nothing(spark):
    none, some = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([], [(1, "a b")]))
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(some, items.where("false")).count() == 0
    assert ranked_search.search(some.where("text is null"), items).count() == 0


def test_blocks_never_lose_a_document(monkeypatch):
    """Small blocks, so that most lists have several: best scores equal those over all rows, and some blocks are skipped."""
    monkeypatch.setattr(ranked_search, "BLOCK", 6)
    monkeypatch.setattr(ranked_search, "FEW", 3)
    rng, width, n = np.random.default_rng(9), 60, 500
    lists = [np.unique(rng.zipf(1.3, rng.integers(1, 20)) % width) for _ in range(n)]
    counts = [rng.integers(1, 9, len(x)) for x in lists]
    pointer = np.append(0, np.cumsum([len(x) for x in lists]))
    terms, sizes = np.concatenate(lists), np.array([c.sum() for c in counts])
    values = ranked_search.impacts(np.concatenate(counts), np.repeat(sizes, np.diff(pointer)), n, int(sizes.sum()))
    weights = rng.integers(1, 5000, width)
    shard = ranked_search.Shard.built(list(range(n)), pointer, terms, values, weights)
    shard = ranked_search.Shard.read(shard.row(1), width)
    scored, own = [], shard.scores
    monkeypatch.setattr(shard, "scores", lambda rows, query: scored.append(len(rows)) or own(rows, query))
    for _ in range(60):
        query = np.zeros(width, np.int64)
        chosen = rng.choice(width, 8, replace=False)
        query[chosen] = weights[chosen]
        every = np.array([(values[a:b] * query[terms[a:b]]).sum() for a, b in zip(pointer[:-1], pointer[1:])])
        want = sorted(every[every > 0].tolist(), reverse=True)[:10]
        assert sorted((s for _, s in shard.search(query, 10, 0)), reverse=True)[:10] == want
        assert all(every[r] == s for r, s in shard.search(query, 10, want[-1]))
        assert len(shard.search(query, 10, want[0] + 1)) == 0
    assert sum(scored) < 60 * 3 * n / 2


PAGES = [
    (1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (5, "http://e\r\nX: y", "<p>same</p>"), (3, None, None), (4, "http://d", ""), (None, "http://n", "<p>lone é</p>"),
    (6, "http://f", "x" * 50_000), (7, "http://g", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "http://h", "twice"), (8, "http://h", "twice"), (None, "http://i", "<p>same</p>"),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "u", 5) for r in rows], "page_id long, url string, html string, digest string, part int")


@pytest.mark.parametrize("least", [0, 6])
def test_archives_round_trip(spark, tmp_path, least):
    index = warc.write_archives(pages_of(spark, PAGES), str(tmp_path / "w"), least=least, frame_bytes=700, archive_bytes=20_000)
    rows = warc.read_archives(index, with_payload=True).collect()
    assert len(rows) == len(PAGES) and len({r["record_id"] for r in rows}) == len(PAGES)
    payloads = Counter((p, (h or "").encode()) for p, _, h in PAGES)
    want = Counter((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode()) for p, h in payloads.elements())
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in rows) == want
    kept = {r["record_id"]: r for r in rows if r["record_type"] == "response"}
    for payload in {h for _, h in payloads}:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same = [r for r in rows if r["payload_digest"] == digest]
        top = max((r["page_id"] for r in same if r["page_id"] is not None), default=None)
        own = [r for r in same if r["record_type"] == "response"]
        assert len(own) == (1 if len(payload) >= least else len(same))
        assert all(bytes(r["payload"]) == payload for r in own)
        if len(payload) >= least:
            assert own[0]["page_id"] == top and all(r["refers_to"] == top for r in same if r["record_type"] == "revisit")
    assert len(kept) >= 6 and all("\r" not in r["url"] for r in rows)


def test_records_by_identifier(spark, tmp_path):
    many = [(i, f"http://{i}", f"page {i} " * (i % 40)) for i in range(300)]
    index = warc.write_archives(pages_of(spark, many), str(tmp_path / "w"), frame_bytes=2000, archive_bytes=30_000)
    assert index.select("archive", "frame").distinct().count() > index.select("archive").distinct().count() > 1
    assert index.where("offset > 0").count() > 100
    wanted = index.where(F.col("page_id") % 7 == 3)
    names = {r["page_id"]: r["record_id"] for r in wanted.collect()}
    got = {r["page_id"]: r for r in warc.fetch(wanted).collect()}
    assert {p: r["record_id"] for p, r in got.items()} == names
    for p, r in got.items():
        assert r["record_type"] == "revisit" or bytes(r["payload"]).decode() == many[p][2]


def test_archive_is_plain_zstandard(spark, tmp_path):
    """Frames one after the other hold the records; readers skip the seek table; a damaged frame is noticed."""
    import zstandard

    index = warc.write_archives(pages_of(spark, PAGES), str(tmp_path / "w"))
    path = index.first()["archive"]
    with open(path, "rb") as f:
        text = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        table = warc.seek_table(warc._opened(path))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and len(text) == sum(raw for _, raw, _ in table)
    data = bytearray(open(path, "rb").read())
    data[-warc.FOOTER.size - 1] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="differs from its checksum"):
        warc.read_archives(index).collect()


def test_archives_of_nothing(spark, tmp_path):
    index = warc.write_archives(pages_of(spark, PAGES).where("false"), str(tmp_path / "w"))
    assert index.count() == 0 and warc.read_archives(index).count() == 0 and warc.fetch(index).count() == 0
