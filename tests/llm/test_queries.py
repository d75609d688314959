"""The registered corpus queries against their SQL twins and against plain Python, on the edge-case corpus."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from compare import connect, table_rows

from shelfspark.llm import bpe, language, lattice, registry, scoring, toxicity


@pytest.fixture(scope="module")
def got(spark, corpus):
    """Rows of a query, run once."""
    cache = {}

    def of(name):
        if name not in cache:
            df = registry.QUERIES[name](spark, corpus)
            cache[name] = (df.columns, [r.asDict(recursive=True) for r in df.collect()])
        return cache[name]

    return of


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def bag(rows, cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(got, corpus, name):
    cols, rows = got(name)
    res = connect(corpus).execute(registry.ORACLES[name])
    want_cols = [d[0] for d in res.description]
    assert table_rows(cols, [tuple(r[c] for c in cols) for r in rows]) == table_rows(want_cols, res.fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", [q for q in sorted(registry.QUERIES) if not q.startswith(("op1_", "op2_", "op12_"))])
def test_one_row_per_document(got, rows_of, name):
    assert bag(got(name)[1], ["doc_id"]) == bag(rows_of("documents"), ["doc_id"])


def test_warc_digests(got, rows_of):
    rows = got("op2_warc")[1]
    b32 = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = collections.Counter((p["page_id"], len((p["html"] or "").encode()), b32(p["html"])) for p in rows_of("pages"))
    assert bag(rows, ["page_id", "payload_bytes", "payload_digest"]) == want
    assert all(r["verified"] for r in rows)


def test_language(got, rows_of):
    rows = got("op3_language")[1]
    truth = {d["doc_id"]: d for d in rows_of("documents")}
    for r in rows:
        t = truth[r["doc_id"]]["text"] if r["doc_id"] not in (308, None) else "x"
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t)) or r["doc_id"] is None
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]) > 0.97


def test_language_vectors():
    enc = language.Encoder(64)
    t = "Ab ab1c\n"
    letters = [0, ord("a"), ord("b"), 0, ord("a"), ord("b"), 0, ord("c"), 0]
    want = sum(
        np.roll(enc.letter(a), 2) * np.roll(enc.letter(b), 1) * enc.letter(c) for a, b, c in zip(letters, letters[1:], letters[2:]) if b
    )
    assert np.array_equal(enc.bundle([enc.grams(t)])[0], want)
    long = "abc dé " * 400_000  # several blocks
    k, n = enc.grams(long)
    k2, n2 = enc.grams("abc dé " * 4)
    assert set(k) == set(k2) and n.sum() == n2.sum() * 100_000


PII = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def pii_ok(k, m):
    d = re.sub("[^0-9]", "", m)
    if k == 1:
        return all(int(p) <= 255 for p in m.split("."))
    if k == 2:
        worth = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in worth) % 10 == 0
    return k == 0 or 8 <= len(d) <= 15


def base_spans(t):
    kinds = ("email", "ip", "card", "phone")
    return [f"{kinds[k]}:{m.start()}:{m.end()}" for k in range(4) for m in PII[k].finditer(t or "") if pii_ok(k, m.group())]


def test_pii_base(got, rows_of):
    want = collections.Counter()
    for d in rows_of("documents"):
        s = base_spans(d["text"])
        n = [sum(x.startswith(k) for x in s) for k in ("email", "ip", "card", "phone")]
        want[(d["doc_id"], *n, hashlib.sha256(",".join(s).encode()).hexdigest())] += 1
    rows = got("op4_pii")[1]
    assert bag(rows, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]) == want
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert set(base_spans(next(d["text"] for d in rows_of("documents") if d["doc_id"] == 307))) <= set(spans[307].split(","))


def test_simhash_components(got, rows_of):
    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    memo = {}
    docs = [(d["doc_id"], memo.setdefault(d["text"], fp(d["text"]))) for d in rows_of("documents")]
    comp = {f: f for f in memo.values()}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in comp:
        for b in comp:
            if a < b and (a ^ b).bit_count() <= 2:
                comp[root(a)] = root(b)
    least = {}
    for i, f in docs:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    want = collections.Counter((i, f"{f:016x}", least.get(root(f))) for i, f in docs)
    assert bag(got("op5_simhash")[1], ["doc_id", "fingerprint", "component_id"]) == want


def test_token_counts(got, rows_of):
    pieces = {p: s for p, s in lattice.load().items() if not p.startswith("<0x")}
    worst = min(lattice.load().values()) - 10.0

    def best(w):
        s, at = "▁" + w, [(0.0, 0)]
        for j in range(1, len(s) + 1):
            found = [(at[i][0] + pieces[s[i:j]], -at[i][1] - 1) for i in range(max(0, j - 16), j) if s[i:j] in pieces]
            if s[j - 1] not in pieces:
                b = len(s[j - 1].encode())
                found.append((at[j - 1][0] + worst * b, -at[j - 1][1] - b))
            top = max(found)
            at.append((top[0], -top[1]))
        return at[-1][1]

    memo = {}
    want = collections.Counter()
    for d in rows_of("documents"):
        w = [x.decode() for x in (d["text"] or "").encode().split()]
        want[(d["doc_id"], len(w), sum(memo[x] if x in memo else memo.setdefault(x, best(x)) for x in w))] += 1
    assert bag(got("op6_token_counts")[1], ["doc_id", "n_words", "n_tokens"]) == want


def test_toxicity(got, rows_of):
    rows = got("op7_toxicity")[1]
    truth = {d["doc_id"]: d["toxic"] for d in rows_of("labels") if d["doc_id"] is not None and d["doc_id"] < 200}
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 7]
    assert np.mean([p == y for p, y in held]) > 0.9 and sum(p for p, _ in held) > 0


def test_toxicity_without_labels(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet").where("false"))
    assert toxicity.drop_toxic(docs, spark.read.parquet(f"{corpus}/labels.parquet").where("false")).count() == docs.count() and not model.words


def test_scoring(got, rows_of):
    docs = rows_of("documents")
    tok = [(d["doc_id"], (d["text"] or "").encode().lower().split()) for d in docs]
    train = collections.Counter()
    for i, w in tok:
        if fold(i, 5) != 1:
            train.update([*w, None])
    n, v = sum(train.values()), len(train)
    want = collections.defaultdict(list)
    for i, w in tok:
        ws = [*w, None]
        want[i].append((len(ws), sum(train[x] > 0 for x in ws), n, math.fsum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ws)))
    have = collections.defaultdict(list)
    for r in got("op9_scoring")[1]:
        assert r["held_out"] == (fold(r["doc_id"], 5) == 1) and r["score"] < 0
        have[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
    assert have.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(have[i]), sorted(want[i])):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)


def test_scoring_sums_all_segmentations():
    weights = scoring.first_weights(lattice.load())
    walk = scoring.walk_of(weights)

    def every(s):
        if not s:
            yield 0.0
        for j in range(1, min(16, len(s)) + 1):
            if s[:j] in weights:
                for rest in every(s[j:]):
                    yield weights[s[:j]] + rest

    words = ["the", "thering", "on", "ich", "schein", "a", "ab", "abc"]
    for word, alpha in lattice.forward(walk, words):
        assert alpha[-1] == pytest.approx(math.log(sum(map(math.exp, every("▁" + word)))))
    uses = {}
    for word, alpha in lattice.forward(walk, ["ab"]):
        lattice.expected(walk, alpha, 2.0, uses)
    total = sum(math.exp(x) for x in every("▁ab"))
    whole = math.exp(weights["▁ab"]) / total if "▁ab" in weights else 0.0
    assert uses.get("▁ab", 0.0) == pytest.approx(2 * whole)


def test_scoring_rare_words_join(spark, corpus, got):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "text")
    few = scoring.score(docs, scoring.fold(scoring.F.col("doc_id"), 5) == 1, frequent=5)
    cols = ["doc_id", "n_tokens", "n_known", "train_tokens"]
    rows = [r.asDict() for r in few.collect()]
    assert bag(rows, cols) == bag(got("op9_scoring")[1], cols)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 3))
    for a, b in zip(sorted(rows, key=key), sorted(got("op9_scoring")[1], key=key)):
        assert a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"])


def test_log_ratios(spark):
    grams = [("", "idiot", 1, 30), ("", "the", 300, 40), ("", "rare", 1, 0), ("the", "idiot", 0, 9), ("idiot", "the", 1, 4), ("the", "rare", 1, 0)]
    df = spark.createDataFrame([(a.encode(), b.encode(), x, y) for a, b, x, y in grams], "a binary, b binary, n0 long, n1 long")
    words, pairs = toxicity.log_ratios(df)
    t, both, follows = (302, 70), 372, {"idiot": 1, "the": 1, "rare": 1}
    kept = lambda n: max(n - toxicity.DISCOUNT, 0)
    p = {b: [kept(n) / t[c] + toxicity.DISCOUNT * 3 / both * follows[b] / 3 + toxicity.PRIOR / both for c, n in enumerate((x, y))] for a, b, x, y in grams if not a}
    got = {bytes(r["w"]).decode(): r["x"] for r in words.collect()}
    assert all(abs(got[b] - math.log(p[b][1] / p[b][0])) < 1e-12 for b in p)
    want = []
    for a, b, x, y in grams:
        if a:
            q = [kept(n) * both / (2 * t[c]) + 2 * toxicity.PRIOR * p[b][c] / sum(p[b]) for c, n in enumerate((x, y))]
            want.append(math.log(q[1] / q[0]))
    assert np.allclose(sorted(r["x"] for r in pairs.collect()), sorted(want))


def test_bpe(got, rows_of):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load(bpe.vocabulary_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter()
    for d in rows_of("documents"):
        ids = enc.encode_ordinary(d["text"] or "")
        want[(d["doc_id"], len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((d["text"] or "").encode()))] += 1
    assert bag(got("op13_bpe")[1], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want


def test_merkle_leaves_differ_where_line_feeds_went(got, rows_of):
    rows = got("op11_merkle")[1]
    texts = collections.defaultdict(set)
    for d in rows_of("documents"):
        texts[d["doc_id"]].add(d["text"])
    for r in rows:
        if len(texts[r["doc_id"]]) == 1:
            (t,) = texts[r["doc_id"]]
            even = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0
            assert r["verified"] == (not (even and t and "\n" in t)) and (r["folded_root"] == r["root"]) == r["verified"]
    assert {r["verified"] for r in rows} == {True, False} and len({r["root"] for r in rows}) == 1
