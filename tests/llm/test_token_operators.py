"""Alignment, token files and spelling variants against plain versions, and on tables where things go wrong."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from assaygrid.llm import alignment, spelling, token_files
from assaygrid.plans.bind import table
from check import rows_of
from tests.llm import cases
from tests.llm.cases import pairs, prose

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    None,
    " ",
    "  two  spaces\t\ttabs\n\n\nlines \r\n",
    "a▁piece mark",
    "<|endoftext|><s></s><unk><0x41> [INST]",
    "漢字仮名交じり文 😀👩‍👩‍👧 é ́ ﬁ Ａ",
    "x\u0000y",
    "=" * 3000,
    "Ünïcödé  ＷＩＤＥ ΣΑΣ İ",
    "'s 't don't I'LL 12345 ...!!??",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    return docs + [(1000 + n, t) for n, t in enumerate(ODD)] + [(2000, docs[0][1]), (None, "no id"), (None, None)]


# --- alignment


def plain_alignment(docs):
    """Groups by the ends both sides share, links by overlapping ranges, from the libraries' tokens."""
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    to_byte = {}
    extra = 256
    for byte in range(256):
        shown = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
        to_byte[chr(byte if shown else extra)] = byte
        extra += not shown

    def piece(n):
        raw = b.id_to_piece(n)
        return bytes([int(raw[1:-1], 16)]) if b.is_byte(n) else raw.replace("▁", " ").encode()

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    found, counts = [], Counter()
    for i, text in docs:
        if not text:
            found.append((i, None))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(to_byte[c] for c in a.id_to_token(n)) for n in ids_a]
        bytes_b = [piece(n) for n in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append((i, None))
            continue
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        shared = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, x, y = [], 0, 0
        for end in shared:
            u, v = x, y
            while x < len(ra) and ra[x][1] <= end:
                x += 1
            while y < len(rb) and rb[y][1] <= end:
                y += 1
            groups.append(",".join(map(str, ids_a[u:x])) + "|" + ",".join(map(str, ids_b[v:y])))
        links, first = [], 0
        for n, (lo, hi) in enumerate(ra):
            while rb[first][1] <= lo:
                first += 1
            for m in range(first, len(rb)):
                if rb[m][0] >= hi:
                    break
                links.append((ids_a[n], ids_b[m]))
        counts.update(links)
        found.append((i, (len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for i, told in found:
        if told is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, digest = told
            best = sum(counts[p] == highest[p[1]] for p in links)
            out.append((i, n_a, n_b, n_groups, len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [alignment.TABLE, 300, 0])
def test_alignment(spark, texts, limit):
    """Counts do not depend on how many pairs a task holds."""
    got = alignment.link_counts(pairs(spark, texts), *PATHS, ["doc_id"], limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_alignment(texts)


def test_alignment_query(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_token_alignment"](spark, sf).collect()), key=repr) == plain_alignment(docs)


def test_align_random_ends():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(1, 200)
        a = sorted({*rng.sample(range(n), rng.randrange(n)), n})
        b = sorted({*(a if rng.random() < 0.5 else ()), *rng.sample(range(n), rng.randrange(n)), n} - set(rng.sample(range(n), n // 3)))
        groups_a, groups_b, link_a, link_b = alignment.align(a, b)
        shared = sorted(set(a) & set(b))
        assert [a[x] for x in groups_a] == shared and [b[x] for x in groups_b] == shared
        touching = {(x, y) for x in range(len(a)) for y in range(len(b)) if max((0, *a)[x], (0, *b)[y]) < min(a[x], b[y])} if a[0] and b[0] else None
        if touching is not None:
            assert sorted(zip(link_a.tolist(), link_b.tolist())) == sorted(touching)


def test_token_groups_keep_columns(spark):
    docs = cases.table(spark).withColumnRenamed("ids", "ids_a")
    out = alignment.token_groups(docs, *PATHS)
    assert out.columns == [*docs.columns, "ids_a_", "ids_b", "ends_a", "ends_b"]
    for r in out.collect():
        assert len(r.ends_a) == len(r.ends_b) and (not r.ends_a or (r.ends_a[-1], r.ends_b[-1]) == (len(r.ids_a_), len(r.ids_b)))
    empty = cases.table(spark, [])
    assert alignment.token_groups(empty, *PATHS).collect() == [] and alignment.link_counts(empty, *PATHS).collect() == []
    counted = alignment.link_counts(docs, *PATHS)
    assert counted.columns[: len(docs.columns)] == docs.columns and counted.count() == docs.count()


# --- files of token ids


def blocks():
    rng = np.random.default_rng(5)
    out = [rng.integers(0, 2**w, token_files.BLOCK, dtype=np.uint64).astype(np.uint32) for w in range(33)]
    out += [np.full(token_files.BLOCK, v, np.uint32) for v in (0, 7, 2**32 - 1)]
    spiky = rng.integers(500, 520, token_files.BLOCK).astype(np.uint32)
    spiky[[0, 17, 1023]] = 0, 2**32 - 1, 49_407
    return np.array([*out, spiky, np.sort(spiky)])


def test_blocks_round_trip():
    values = blocks()
    packed = token_files.pack(values)
    raw = b"".join(packed)
    starts = np.cumsum([0, *map(len, packed)])[:-1]
    assert (token_files.unpack(raw, starts) == values).all()
    assert (token_files.unpack(raw, starts[[35, 3, 36]]) == values[[35, 3, 36]]).all()
    # outliers leave the width alone: 5 bits for ids, and six bytes for each outlier
    assert len(packed[-2]) == token_files.HEAD_SIZE + 10 * 128 + 2 * 6


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_shards(monkeypatch, chunk):
    """Documents shorter and longer than a block and a chunk, empty ones, and any run of ids."""
    monkeypatch.setattr(token_files, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    docs = [(n if n % 7 else None, rng.integers(0, 60_000, size).astype(np.uint32)) for n, size in enumerate([5, 0, 1, 1023, 1, 1024, 4000, 0, 3, 9999, 0])]
    sink = io.BytesIO()
    writer = token_files.Writer(sink)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    total = sum(len(ids) for _, ids in docs)
    assert writer.close() == (len(docs), total)
    raw = sink.getvalue()
    reader = token_files.Reader(io.BytesIO(raw), len(raw))
    flat = np.concatenate([ids for _, ids in docs])
    for a, b in [(0, total), (3, 4), (1029, 2055), (total - 1, total + 9), (total, total + 1), (5, 5)]:
        assert reader.ids(a, b).tolist() == flat[a:b].tolist()
    found = [[] for _ in docs]
    for doc, ids in reader.runs():
        found[doc] += ids.tolist()
    assert found == [ids.tolist() for _, ids in docs]
    assert [None if none else i for i, none in zip(reader.doc_ids.tolist(), reader.no_id)] == [i for i, _ in docs]
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(raw[:-1]), len(raw) - 1)


def plain_tokens(docs):
    tokenizer = Tokenizer.from_file(WORDS)
    out, start = [], 0
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids))))
        start += len(ids)
    return out


def test_token_files(spark, texts):
    with open(WORDS, encoding="utf-8") as file:
        definition = file.read()
    docs = sorted((d for d in texts if d[0] is not None), key=lambda d: d[0])
    shuffled = random.Random(2).sample(docs, len(docs))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    manifest = token_files.write(pairs(spark, shuffled), definition)
    spark.conf.unset(merge)
    assert manifest.count() > 1
    assert sorted(map(tuple, token_files.read(manifest).collect())) == plain_tokens(docs)
    # null ids come first, rows that are equal stay
    twice = pairs(spark, [(None, "b a"), (3, "x"), (3, "x"), (None, None)])
    got = sorted(map(tuple, token_files.read(token_files.write(twice, definition)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 3, 3] and [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    assert token_files.read(token_files.write(pairs(spark, []), definition)).collect() == []
    assert token_files.write(cases.table(spark), definition).agg({"n_docs": "sum"}).first()[0] == len(cases.rows())


def test_token_files_query(spark, sf):
    docs = sorted(tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, sf).collect())) == plain_tokens(docs)


def test_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 3)
    with open(WORDS, encoding="utf-8") as file:
        pieces = token_files.Pieces(file.read()).ready()
    tokenizer = Tokenizer.from_file(WORDS)
    for text in ["one two three four five", "five four " + "z" * 100, *[t or "" for t in ODD], "two one"]:
        assert pieces.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# --- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def test_spelling_query(spark, sf):
    """The query over all documents; its SQL agrees with Spark's result at this size, too."""
    import duckdb

    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    df = QUERIES["op13_spelling_variants"](spark, sf)
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == plain_variants(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(ORACLES["op13_spelling_variants"])
    assert rows_of(df.columns, got) == rows_of([d[0] for d in cur.description], cur.fetchall())


def crowded():
    """Words that share one half with very many others, chains of forms, and letters beyond ASCII."""
    rng = random.Random(8)
    words = {"prefix" + "".join(rng.choice("abÀÿ") for _ in range(rng.randrange(7))) for _ in range(900)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randrange(4))) + "suffix" for _ in range(60)}
    words |= {w[:k] + w[k + 1 :] for w in sorted(words)[:300] for k in (0, 3, len(w) - 1)} | {"a" * k for k in range(6, 30)}
    words |= {"aaaaaab" + "c" * k for k in range(6)}
    return [(w, 5 ** rng.randrange(1, 5) + rng.randrange(3)) for w in sorted(words) if len(w) >= 6]


@pytest.mark.parametrize("crowd", [0, 2, 64])
def test_near_pairs_of_crowds(spark, crowd):
    """However few words may be compared in a group, all pairs are found, and each once."""
    words = crowded()
    got = [tuple(r) for r in spelling.near_pairs(spark.createDataFrame(words, "word string, n bigint"), crowd).collect()]
    n = dict(words)
    want = {frozenset((a, b)) for a in n for b in n if a < b and one_edit(a, b)}
    assert len(got) == len(want) and {frozenset((a, b)) for a, _, b, _ in got} == want
    assert all(n[a] == k and n[b] == m for a, k, b, m in got)


def test_spelling_of_odd_tables(spark):
    rows = [(None, "Lettered " * 6), (1, None), (2, ""), (3, "LETTERED lettered"), (3, "LETTERED lettered"), (4, "× ÷ ÀÉÎõü lettéred " * 700), (5, "a" * 50_000 + " ")] + [(6, "b" * 30_000)] * 5
    got = sorted(map(tuple, spelling.variants(spelling.vocabulary(pairs(spark, rows))).collect()))
    assert got == plain_variants(rows)
    assert spelling.variants(spelling.vocabulary(pairs(spark, []))).collect() == []
    assert spelling.variants(spelling.vocabulary(cases.table(spark))).columns == ["word", "form", "root", "n", "n_near", "form_n"]
