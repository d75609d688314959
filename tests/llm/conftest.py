"""Small corpora with every edge case, written as the tables that the queries read."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

CLASH = ["key", "h", "w", "n", "at", "items", "row", "tokens", "epoch", "domain", "language", "src", "kid", "host", "lines", "rid", "fp", "node", "score", "held", "word", "part", "t", "base", "found", "mix_note"]
SYLLABLES = {"en": ["th", "er", "ing", "on", "an", "re", "at", "ou"], "de": ["sch", "ung", "heit", "ein", "ich", "ö", "ver", "ß"]}
TOXIC = ["idiot", "scum", "moron", "trash"]


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def text(rng, lang, n):
    w = words(rng, lang, n)
    return "".join(x + ("\n" if rng.random() < 0.08 else " ") for x in w).strip()


def put(folder, name, cols):
    pq.write_table(pa.table(cols), f"{folder}/{name}.parquet")


def tables(folder, docs, labels, bench, pages):
    """docs: (doc_id, text, lang, source); every table gets extra columns with names that the operators use inside."""
    extra = lambda n: {c: pa.array(["x"] * n, pa.string()) for c in CLASH}
    col = lambda rows, i, t: pa.array([r[i] for r in rows], t)
    put(folder, "documents", {
        "doc_id": col(docs, 0, pa.int64()), "text": col(docs, 1, pa.string()), "lang": col(docs, 2, pa.string()), "source": col(docs, 3, pa.string()),
        "n_chars": pa.array([len(r[1]) if r[1] is not None else None for r in docs], pa.int64()), **extra(len(docs)),
    })
    put(folder, "labels", {"doc_id": col(labels, 0, pa.int64()), "quality": pa.array([1] * len(labels), pa.int64()), "toxic": col(labels, 1, pa.int64()), **extra(len(labels))})
    put(folder, "benchmark", {"item_id": col(bench, 0, pa.int64()), "text": col(bench, 1, pa.string()), **extra(len(bench))})
    put(folder, "pages", {"page_id": col(pages, 0, pa.int64()), "url": col(pages, 1, pa.string()), "html": col(pages, 2, pa.string()), **extra(len(pages))})


@pytest.fixture(scope="session")
def corpus(tmp_path_factory):
    rng = random.Random(5)
    docs = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        body = text(rng, lang, rng.randint(60, 160))
        if i % 6 == 1:  # toxic texts
            body = " ".join(w for x in body.split(" ") for w in ([x, rng.choice(TOXIC)] if rng.random() < 0.1 else [x])) + " idiot scum moron"
        docs.append((i, body, lang, f"src{0 if i % 3 == 0 else i % 20}"))
    bench = [(b, " ".join(words(rng, "en", 14))) for b in range(6)] + [(7, "Short item"), (8, ""), (9, None), (None, " ".join(words(rng, "en", 11))), (0, bench_again(rng))]
    docs[10] = (10, docs[10][1] + "\n" + bench[0][1].upper() + "\n" + docs[11][1], "en", "src10")
    docs[14] = (14, "so: SHORT, item! " + docs[14][1], "en", "src14")
    docs[16] = (16, bench[9][1], "en", "src16")
    # near copies of one text, exact copies of another, a long line that many documents of a host share
    base = docs[20][1].split(" ")
    for i in range(200, 206):
        c = list(base)
        c[5 + i % 7] = "changed"
        docs[i] = (i, " ".join(c), "en", "src0")
    for i in range(206, 212):
        docs[i] = (i, docs[25][1], "en", "src0")
    shared = " ".join(words(rng, "en", 120))
    for i in range(212, 236):
        docs[i] = (i, shared + "\n" + " ".join(words(rng, "en", 40)), "en", "src0")
    docs += [
        (300, None, "en", "src1"), (301, "", "en", None), (302, " \t\n\x0b\x0c\r ", None, "src2"), (None, text(rng, "en", 70), "en", "src3"), (None, None, None, None),
        (303, "same same same same same same", "en", "src4"), (304, "12 + 34 = 46 !!", None, "other"), (305, "x" * 20_000, "en", "src5"), (306, "1 2 " * 1500, None, "src6"),
        (307, "Mail a.b+c@x-y.example.org or a@b.c_d@e.f or 1.2.3.4.5.6.7.8 and 300.1.1.1 or +1 (444) 555-4984, card 4111 1111 1111 1111 or 4111111111111112.", "en", "src7"),
        (308, text(rng, "en", 400) + " " + text(rng, "de", 1500), "de", "src8"), (308, "another text of the same id", "en", "src8"), (309, "one", "en", "src9"), (310, "two words", "en", "src9"),
        (311, "ÄÖÜ Straße ΣΑΣ İstanbul 漢字かな 🙂", "de", "src9"), (312, "one", "en", "src9"),
    ]
    docs += [docs[3], docs[3], docs[244]]  # repeated rows
    labels = [(i, 1 if i % 6 == 1 else 0) for i in range(200)] + [(None, 1), (5, None), (7, 0), (7, 1), (9999, 1)]
    pages = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(40)]
    pages += [(None, None, None), (None, "http://h/\r\nx y", "<p>null id</p>"), (100, "u", "é" * 70_000), (101, "u", "é" * 70_000), (3, "u", "again"), (3, "u", "again"), (-4, "u", "again")]
    folder = tmp_path_factory.mktemp("corpus")
    tables(folder, docs, labels, bench, pages)
    return str(folder)


def bench_again(rng):
    return " ".join(words(rng, "de", 12))


@pytest.fixture(scope="session")
def nothing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("nothing")
    tables(folder, [], [], [], [])
    return str(folder)


@pytest.fixture(scope="session")
def rows_of(corpus):
    """Rows of a table as dictionaries."""
    return lambda name: pq.read_table(f"{corpus}/{name}.parquet").to_pylist()
