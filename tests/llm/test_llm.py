"""Small cases of the training-data operators: nulls, empty and repeated rows, clashing columns, brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from cellframe.llm import bpe, chat, decontaminate, license, minhash, nearest, tokenids, toxicity, urlfilter, warc

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "ONE two"), (5, " ".join(base)), (6, " ".join(base)),
            (7, " ".join(base[:60] + ["changed"] + base[61:])), (8, "İK cc by cc BY x " + "ß" * 5000)]
    rows += [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90)))) for i in range(9, 40)]
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, digest string, n int, rep int"), dict(rows)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates(docs):
    df, texts = docs
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_without_ids(spark):
    """A row without an id is kept only where its component has no id, and then one row is."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(rng.choices(WORDS, k=80)) for _ in range(4))
    rows = [(7, a), (None, a), (3, a + " end"), (None, b), (None, b), (None, b + " end"), (None, c), (None, None), (None, " "), (9, d), (9, d)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __n int")
    got = minhash.keep_one(df, k=5, percent=80)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    of_b = [x for x in kept if x[1] in (b, b + " end")]
    assert got.columns == df.columns and len(of_b) == 1 and of_b[0][0] is None
    assert sorted(map(str, set(kept) - set(of_b))) == sorted(map(str, {(3, a + " end"), (None, c), (None, None), (None, " "), (9, d)}))
    assert len(kept) == 7 and minhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_with_repeated_ids(spark):
    """An id on a copy and on an unrelated text loses the copy alone."""
    rng = random.Random(12)
    a, b, c = (" ".join(rng.choices(WORDS, k=60)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (5, b), (8, b + " end"), (9, c), (9, None)]
    kept = [(r["doc_id"], r["text"]) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(3, a), (5, b), (5, b), (9, c), (9, None)]))


def test_token_files_and_bpe(docs):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    df, texts = docs
    t = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenids.token_files(df, bpe.tokenizer_path("byte_bpe_50k.json")).collect()}
    at, want = 0, {}
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(200):
        x = "".join(rng.choice([" ", "  ", "\n", "\t", "a", "bc", "'s", "é", "12", "漢", "\x1c", "🙂", "!?"]) for _ in range(30))
        assert coder.encode(x) == e.encode_ordinary(x) and coder.decode(coder.encode(x)) == x.encode()
    assert coder.encode("ab" * 30_000) == e.encode_ordinary("ab" * 30_000)
    rows = {r["doc_id"]: r for r in bpe.digests(df, path, public_tokenizers.PATTERN).collect()}
    assert rows[0]["n_tokens"] == 0 and rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_added_tokens(spark):
    """Added tokens inside texts, against the library's defaults."""
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    t, end = Tokenizer.from_file(path), "<|endoftext|>"
    texts = ["plain text", f"one{end}two", f"{end}", f" a  {end} {end}{end}\n b's", "<|endoftext", f"é {end[:5]}{end}", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokenids.tokenise(df, path).collect()}
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert 50256 in got[1] and 50256 not in got[4]


def test_ranks_in_any_order():
    """Vocabularies in which a merge brings up a pair of a lower rank than its own."""
    import tiktoken

    rng = random.Random(4)
    for _ in range(60):
        longer = {"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(25)}
        ranks = {bytes([i]): i for i in range(256)} | {b: 256 + i for i, b in enumerate(rng.sample(sorted(longer), len(longer)))}
        e, coder = tiktoken.Encoding("own", pat_str="[abc]+", mergeable_ranks=ranks, special_tokens={}), bpe.Bpe(ranks, "[abc]+")
        texts = ["abab", *("".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(40))]
        assert [coder.encode(x) for x in texts] == [e.encode_ordinary(x) for x in texts]
        found = bpe.Digests(coder)(texts)
        assert found[0] == [len(e.encode_ordinary(x)) for x in texts]
        assert found[1] == [hashlib.sha256(",".join(map(str, e.encode_ordinary(x))).encode()).hexdigest() for x in texts]
        assert found[2] == [hashlib.sha256(x.encode()).hexdigest() for x in texts]


def test_code_lengths():
    for counts in ([1], [5, 5], [1, 1, 2, 4, 8, 16, 32, 64, 128], list(range(1, 300))):
        lengths = tokenids.code_lengths(np.array(counts), 9)
        assert lengths.max() <= 9 and sum(2.0 ** -int(n) for n in lengths) <= 1
        code = tokenids.Code(np.arange(len(counts)), lengths)
        ids = np.random.default_rng(1).integers(0, len(counts), 1000).astype(np.uint32)
        data, ends, inside = code.encode(ids, np.array([400, 400, 1000]))
        starts = np.array([0, ends[1] * 8, ends[1] * 8 + inside[400 + 256], ends[1] * 8 + inside[400 + 512]])
        assert (code.decode(data, starts, np.array([400, 256, 256, 88])) == ids).all()


@pytest.mark.parametrize("limit", [1 << 24, 200])
def test_contamination(spark, docs, limit):
    df, texts = docs
    words = texts[5].split()
    items = [(0, " ".join(words[10:30])), (1, "one two"), (2, None), (3, "!"), (10, " ".join(words[50:63])), (None, "w1 w2 w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(df, bench, limit=limit).collect()}
    assert (got[5]["n_hit"], got[5]["n_items"], got[5]["contaminated"]) == (33, 2, True)
    assert got[5]["items_sha256"] == hashlib.sha256(b"0,10").hexdigest()
    assert got[3]["contaminated"] and got[4]["n_hit"] == 2 and got[0]["n_words"] == 0 and not got[1]["contaminated"]
    kept = {r["doc_id"] for r in decontaminate.decontaminate(df, bench, limit=limit).collect()}
    assert kept == {i for i, r in got.items() if not r["contaminated"]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, "spans").collect()}
    assert cut[0] is None and cut[3] == "" and len(cut[5].split()) == 120 - 33


def test_decontaminate_in_blocks(spark):
    """Benchmarks in one block or in many give the same rows: null and repeated ids, and items that overlap in a text."""
    words = [f"v{i}" for i in range(200)]
    bench = spark.createDataFrame([(i, " ".join(words[i : i + 16])) for i in range(0, 160, 7)], "item_id long, text string")
    dirty, clean, half = " ".join(words[:180]), "nothing of the kind", " ".join(WORDS * 20 + words[7:23])
    rows = [(None, dirty), (None, clean), (None, None), (1, dirty), (1, clean), (2, clean), (2, clean), (3, half), (None, half)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, key int")
    listed = lambda x: sorted((str(r["doc_id"]), str(r["text"]), r["key"]) for r in x.collect())
    left = [(str(i), str(t), 5) for i, t in rows if t != dirty]
    cut = [(str(i), str(" ".join(["", *words[170:180]]) if t == dirty else " ".join(WORDS * 20) + " " if t == half else t), 5) for i, t in rows]
    for limit in (1 << 24, 1000):
        assert listed(decontaminate.decontaminate(df, bench, limit=limit)) == sorted(left)
        assert listed(decontaminate.decontaminate(df, bench, "spans", limit=limit)) == sorted(cut)
        assert decontaminate.decontaminate(df, bench, "spans", limit=limit).columns == df.columns


def test_toxicity(spark):
    rng = random.Random(3)
    rows = [(i, " ".join([rng.choice(WORDS) for _ in range(30)] + (["vile"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9999, None), (None, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    assert sum(got[i]["predicted"] == y for i, _, y in rows) >= 0.97 * len(rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i, *_ in rows)
    assert got[9999]["predicted"] == 0 and toxicity.keep_clean(df, labels.limit(0)).count() == len(rows) + 2


def test_urls(spark):
    rows = [(0, None), (1, "no url"), (2, "HTTP://WWW.Example.COM/en/x?q"), (3, "http://example.com/en/"), (4, "http://a.net/es/#f"),
            (5, "http://b.com"), (6, "http://notexample.com/en/"), (7, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.verdicts(df, urlfilter.RULES).collect()}
    assert got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[3][2:] == ("example.com/en/", "block")
    assert got[4][2:] == ("net/es/", "block") and got[6][2:] == ("com/", "allow") and got[5][2] is None
    assert got[0][:3] == got[1][:3] == got[7][:3] == ("", "", None)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).round(3)
    x[40:120] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [None] * 8), (303, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, df.where("vec_id % 20 = 0")).collect()
    for q in range(0, 300, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        want = sorted((-float((x[q] * x[i]).sum()), i) for i in range(300) if i != q)[:20]
        assert [r["vec_id"] for r in mine] == [i for _, i in want]
    assert nearest.search(df.limit(0), df).count() == 0


@pytest.mark.parametrize("depth", [100, 1024])
def test_nearest_repeated_rows(spark, depth):
    """Rows that repeat a query's own id take no places; those of other ids are candidates each."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(3)
    rows = [(i, v) for i, v in enumerate(x)] + [(0, 4 * x[0])] * 60 + [(0, (3 + i / 64) * x[0]) for i in range(30)] + [(1, 2 * x[1])] * 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 1, 5)], df.schema)
    got = nearest.search(df, asked, depth=depth).collect()
    for q in (0, 1, 5):
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        want = [i for _, i in sorted((-float((x[q] * v).sum()), i) for i, v in rows if i != q)[:20]]
        assert len(mine) == 20 and q not in mine
        assert mine == want if depth > len(rows) else len(set(mine) & set(want)) >= 0.9 * len(set(want))


def test_licences(docs, spark):
    df, _ = docs
    more = spark.createDataFrame([(100, "All rights\nRESERVED, general public license; all rights reserved")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license.licences(df.select("doc_id", "text").union(more)).collect()}
    assert (got[100]["n_base"], got[100]["first_word"], got[100]["last_word"], got[100]["base_labels"]) == (3, 0, 6, "gpl,reserved")
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"]) == (2, 1, 3)
    assert got[0]["n_words"] == 0 and got[0]["labels"] == "" and got[0]["first_word"] is None


def test_warc(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/ x", "same"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "é\r\n\r\nWARC/1.1")]
    from cellframe.llm.common import new_path

    path = new_path(spark, "test-warc")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, version=2)
    got = {r["page_id"]: r for r in warc.read_pages(spark, path).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert all(r["payload_digest"] == warc.base32_sha1((h or "").encode()) for i, _, h in rows for r in [got[i]])


def test_arc_files(spark, tmp_path):
    """ARC files of both versions, plain, gzipped whole and by record, with payloads that are no text."""
    import gzip

    body = b"HTTP/1.0 200 OK\nA: b\n\n" + bytes(range(256)) + b"\r\n\r\nWARC/1.1\r\n"
    records = [({"URL": "http://x/a b", "IP-address": "10.0.0.1", "Archive-date": "20010203040506"}, body),
               ({"URL": "dns:x", "Archive-date": "2001", "Content-type": "text/dns"}, b"1 2"), ({"URL": "http://y/", "Archive-date": "20010203"}, body)]
    for version, name in ((1, "plain.arc"), (2, "whole.arc.gz"), (1, "members.arc.gz")):
        parts = [warc.arc_start(name, "20010203", version), *(warc.arc_record(f, b, version) for f, b in records)]
        image = b"".join(parts) if name == "plain.arc" else gzip.compress(b"".join(parts)) if name == "whole.arc.gz" else b"".join(map(gzip.compress, parts))
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_bytes(image)
        found = warc.read_arc(spark, f"file://{folder}").collect()
        assert [r["url"] for r in found] == [f"filedesc://{name}", "http://x/a b", "dns:x", "http://y/"]
        assert bytes(found[1]["block"]) == body and found[1]["digest"] == found[3]["digest"] == warc.base32_sha1(body.split(b"\n\n", 1)[1])
        warc.convert_arcs(spark, f"file://{folder}", f"file://{tmp_path}/out-{name}")
        got = {r["uri"]: r for r in warc.read_warc(spark, f"file://{tmp_path}/out-{name}").collect()}
        assert sorted(r["record_type"] for r in got.values()) == ["resource", "response", "revisit", "warcinfo"]
        a, b = sorted((got["http://x/a b"], got["http://y/"]), key=lambda r: r["record_type"])
        assert b["refers_to_id"] == a["record_id"] and bytes(a["block"]) == body and bytes(b["block"]) == body.split(b"\n\n", 1)[0] + b"\n\n"
        assert got["http://x/a b"]["date"] == "2001-02-03T04:05:06Z" and got["dns:x"]["date"] == "2001-01-01T00:00:00Z"
        members = [p.read_bytes() for p in (tmp_path / f"out-{name}").glob("part-*")]
        assert sum(gzip.decompress(m).count(b"WARC/1.1\r\nWARC-Type") for m in members) == 4  # any gzip reader takes them
    with pytest.raises(warc.ArcError):
        list(warc.parse_arc(b"".join(parts)[:-4]))
    with pytest.raises(warc.ArcError):
        list(warc.parse_arc(gzip.compress(b"".join(parts))[:-20]))


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 1, "bot", "b"),
            (4, None, None, None), (5, 0, "user", "<|im_end|>"), (5, 1, "bot", "x"), (5, 2, "bot", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as part")
    got = {(r["conv_id"], r["part"]): r for r in chat.chats(df, part=2).collect()}
    assert set(got) == {(1, 0), (4, 0), (5, 0), (5, 1)}
    assert got[1, 0]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n" and "< |im_end|>" in got[5, 0]["rendered"]
    assert chat.chats(df.limit(0)).count() == 0
