"""The corpus pipeline as a chain, against a plain Python version of its four stages."""

import base64
import hashlib
import random

import corpus_pipeline

WORDS = [f"w{i}" for i in range(60)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_distinct(rows):
    """Rows whose key is their component's smallest; rows without an id stand behind all ids, each with a key of its own."""
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    unnamed = sorted((digest(t), n) for n, (i, t) in enumerate(rows) if i is None)
    key = {n: (1, at) for at, (_, n) in enumerate(unnamed)} | {n: (0, i) for n, (i, _) in enumerate(rows) if i is not None}
    sets, least = [shingles(t) for _, t in rows], dict(key)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        was = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if was == least:
            break
    return [row for n, row in enumerate(rows) if least[n] == key[n]]


def plain_uncontaminated(rows, items):
    windows = {tuple(w[i : i + 13]) for w in ((t or "").lower().split() for t in items) if w for i in range(max(1, len(w) - 12))}
    out = []
    for row in rows:
        w, hit = (row[1] or "").lower().split(), set()
        for length in {len(x) for x in windows}:
            hit |= {j for i in range(len(w) - length + 1) if tuple(w[i : i + length]) in windows for j in range(i, i + length)}
        if not hit or 20 * len(hit) < len(w):
            out.append(row)
    return out


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    rng = random.Random(8)
    text = lambda words, n: " ".join(rng.choices(words, k=n))
    rows = [(i, text([f"bad{j}" for j in range(10)] if i % 4 == 0 else WORDS, 40)) for i in range(200)]
    item = text([f"q{i}" for i in range(40)], 20)
    near = rows[1][1] + " end"
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 0), (201, None, None)]
    alone, far = text(WORDS, 40), text(WORDS, 40)
    rows += [(201, None), (202, ""), (203, " "), (None, None), (204, near), (None, near), (5, rows[5][1]), (205, rows[6][1]), (None, alone), (None, alone),
             (None, far), (206, f"{text(WORDS, 30)} {item}"), (None, f"{text(WORDS, 30)} {item}"), (207, f"{text(WORDS, 600)} {item}"),
             (208, text([f"bad{j}" for j in range(10)], 40)), (None, text([f"bad{j}" for j in range(10)], 40)), (209, "one two")]
    rows += [(i, " " * (i % 3)) for i in range(300, 360)]  # labelled as clean, so that the model's bias says so of blank texts
    labels += [(i, 1, 0) for i in range(300, 360)]
    bench = [(0, item), (None, "ONE two"), (1, None), (2, "")]

    def put(path, found):
        spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in found], DOCS).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        return str(path)

    got = corpus_pipeline.run(spark, put(tmp_path / "some", rows))
    want = [r for r in rows if "bad" not in (r[1] or "")]
    assert len(want) == len(rows) - 52
    want = plain_uncontaminated(plain_distinct(want), [t for _, t in bench])
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(i, t or "", e.encode_ordinary(t or "")) for i, t in want]
    found = sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect())))
    assert found == sorted(map(str, ((i, len(x), sha(",".join(map(str, x))), sha(t)) for i, t, x in ids)))
    assert corpus_pipeline.run(spark, put(tmp_path / "none", [])).count() == 0
