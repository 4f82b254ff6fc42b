"""Operators that SQL cannot express, against plain versions; models by gradients and held-out accuracy."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import __spark_entry__ as entry_module
import corpus_pipeline
from assaygrid.llm import bpe, language, minhash, mixing, ranking_quality, repeats, search, secrets, shingles, suffixes, toxicity
from assaygrid.plans.bind import table
from check import TABLES, rows_of
from tests.llm.cases import pairs, prose

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
SF2 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op3_mix_sources", "op4_quality_rules", "op8_secret_scan", "op10_bm25_top_k"])
def test_sql(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


# --- near-duplicates


def plain_components(docs, width):
    """Links of all pairs with a shingle in common, by full sets."""
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for ids in holders.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def chained(n):
    """Copies that differ a little more from step to step, so that far ones are linked only through others."""
    rng = random.Random(9)
    words = prose(77, 150).split()
    out = []
    for _ in range(n):
        words = list(words)
        words[rng.randrange(len(words))] = prose(rng.randrange(10**9), 1)
        out.append(" ".join(words))
    return out


def variants(n, places, seed):
    """Texts of 100 words in which each of some places takes one of four words: many alike, few of them near enough."""
    rng = random.Random(seed)
    words = prose(seed, 100).split()
    spots = rng.sample(range(100), places)
    out = []
    for _ in range(n):
        for at in spots:
            words[at] = f"choice{rng.randrange(4)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_of_a_group_around_the_limit(spark):
    docs = [(n, t) for places in (5, 9) for n, t in enumerate(variants(300, places, places), 1000 * places)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(pairs(spark, docs), 4).collect()}
    assert got == plain_components(docs, 4)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in (0, 1, 40, 200, 210, 700, 5000)]
    odd = np.unpackbits(minhash.parities(sets).view(np.uint8), axis=1, bitorder="little")
    for a, s in zip(odd, sets):
        assert a.tolist() == (np.bincount((shingles.mixed(s + shingles.STEP) % np.uint64(minhash.PARITY)).astype(int), minlength=minhash.PARITY) % 2).tolist()
        for b, t in zip(odd, sets):
            assert (a != b).sum() <= len(np.setxor1d(s, t))


def test_near_duplicates(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    docs += [(10_000 + n, t) for n, t in enumerate(chained(60))]
    docs += [(11_000 + n, prose(500 + n % 7, 60 + n)) for n in range(60)]
    docs += [(12_000 + n, " ".join(prose(3, 80).split()[: 40 + n])) for n in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(pairs(spark, docs), 4).collect()}
    assert got == plain_components(docs, 4)


def test_superminhash():
    """Registers against the definition with one shuffle per element; the spread is below that of independent draws."""
    rng = np.random.default_rng(0)

    def plain(elements, m):
        out = [2**64 - 1] * m
        for e in elements:
            order = list(range(m))
            for level in range(m):
                draw = int(shingles.mixed(np.array([e], np.uint64) + minhash.LEVEL[level : level + 1])[0])
                other = (((draw & 0xFFFFFFFF) * (m - level)) >> 32) + level
                order[level], order[other] = order[other], order[level]
                out[order[level]] = min(out[order[level]], (level << 32) | (draw >> 32))
        return out

    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2, 30, 400)]
    assert minhash.superminhash(sets, 48).tolist() == [plain(s, 48) for s in sets]
    errors = []
    for _ in range(150):
        base = rng.integers(0, 2**62, 300).astype(np.uint64)
        a, b = minhash.superminhash([base[:270], base[30:]], 288)
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.0225


# --- repeated strings


def plain_removal(texts, length=repeats.LENGTH):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", gone))
        yield bytes(c for c, g in zip(t, gone) if not g), sum(gone), runs


def repeated_texts():
    rng = random.Random(3)
    passage = prose(11, 80)
    out = []
    for n in range(60):
        cut = passage[rng.randrange(0, 120) : len(passage) - rng.randrange(0, 120)]
        out.append(prose(n, rng.randrange(0, 60)) + " " + cut + " " + prose(n + 100, rng.randrange(0, 60)))
    out += ["ab" * 300, "ab" * 101, "x" * 199, "x" * 200, "y" * 201, "é" * 150, "", "same " * 70, "same " * 70]
    out += [prose(5, 100) + prose(6, 90) + prose(5, 100)]
    return out


def test_repeats(spark, sf, monkeypatch):
    texts = [r.text for r in table(spark, sf, "documents").select("text").collect()][:120] + repeated_texts()
    docs = pairs(spark, list(enumerate(texts)))
    want = list(plain_removal([(t or "").encode() for t in texts]))
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_by_string(spark, monkeypatch):
    """Grams beyond the bound of a task give the same spans."""
    monkeypatch.setattr(repeats, "HOT", 5)
    texts = repeated_texts()
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in repeats.remove_repeats(pairs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == list(plain_removal([t.encode() for t in texts]))


def test_blocks(monkeypatch):
    """A text cut into blocks has the anchors of its strings all the same."""
    monkeypatch.setattr(repeats, "BLOCK", 300)
    raw = (prose(1, 200) + prose(2, 50) + prose(1, 200)).encode()
    found = repeats.text_anchors(raw)
    starts = {s for low, high in zip(found["low"], found["high"]) for s in range(low, high - repeats.LENGTH + 1)}
    assert starts == set(range(len(raw) - repeats.LENGTH + 1))


def test_deep_shallow():
    rng = random.Random(4)
    for _ in range(150):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 150))) for _ in range(rng.randrange(1, 12))]
        strings = base + [b[: rng.randrange(len(b) + 1)] + bytes(rng.choice(b"abc") for _ in range(5)) for b in base for _ in (0, 1)] + base[:3]
        for shallow in (0, 16, 64):
            assert [strings[i] for i in suffixes.deep_shallow(strings, shallow)] == sorted(strings)


def test_gram_hashes():
    raw = np.frombuffer(bytes(random.Random(1).choice(b"ab") for _ in range(700)), np.uint8)
    for size in (1, 5, 24, 200):
        by_gram = defaultdict(set)
        for i, h in enumerate(repeats.gram_hashes(raw, size).tolist()):
            by_gram[raw[i : i + size].tobytes()].add(h)
        assert all(len(v) == 1 for v in by_gram.values()) and len(set().union(*by_gram.values())) == len(by_gram)


# --- tokens


def test_bpe_equals_tiktoken(spark, sf):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [r.text for r in table(spark, sf, "documents").select("text").collect()]
    texts += ["", "a" * 5000, " " * 3000, "日本語 " * 40, "<|endoftext|>", "it's we'll I'D", "\n\n \t x", "".join(rng.choice("abcdeABC 01\n\t!?éß漢😀'") for _ in range(20_000))]
    got = {r.doc_id: r for r in bpe.tokenize(pairs(spark, list(enumerate(texts))), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == other.encode_ordinary(t) and bytes(got[i].decoded) == t.encode()
    row = QUERIES["op6_byte_bpe"](spark, sf).orderBy("doc_id").first()
    text = table(spark, sf, "documents").filter(f"doc_id = {row.doc_id}").first().text
    ids = other.encode_ordinary(text)
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# --- secrets


def test_trigram_queries():
    """Whatever an expression matches satisfies its query."""
    samples = {
        "assign": ["Password = abcdef", "api_key:'abcdefg", "APIKEY=xxxxxxx", "passwd: aaaaaa"], "access": ["AKIA" + "A" * 16], "forge": ["ghp_" + "a" * 36], "chat": ["xoxb-1234567890"],
        "payment": ["sk_live_" + "a" * 16], "cloud": ["AIza" + "b" * 35], "bearer": ["eyJa.eyJb.c"], "pem": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
    }
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.regex)
        assert (query == []) == (rule.kind == "hex")
        for s in samples.get(rule.kind, []):
            assert re.search(rule.regex, s) and any(all(t in s.lower() for t in c) for c in query)


def test_scan_equals_regex(spark):
    rng = random.Random(8)
    parts = ["token", "password", "PassWD", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "abc", "abcdef12", "AKIA", "ABCDEFGH", "0123456789abcdef", "é", "😀", "\n", "xoxb-", "ghp_", "eyJ", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    got = {r.doc_id: r.spans for r in secrets.scan(pairs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), n, m.end()) for n, r in enumerate(secrets.RULES) for m in re.finditer(r.regex, t) if len(m.group(r.group)) >= r.least)
        assert [tuple(s) for s in got[i]] == want, t


# --- search


def test_pruning_is_exact(spark):
    rng = random.Random(6)
    words = [prose(n, 1) + str(n) for n in range(400)]
    texts = [" ".join(words[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randrange(1, 80))) for _ in range(700)]
    docs = pairs(spark, list(enumerate(texts))).repartition(4)
    got = defaultdict(list)
    for r in search.top_k(docs, docs.filter("doc_id % 50 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score * search.UNIT)))
    split = [re.findall(r"\w+", t) for t in texts]
    df = Counter(w for s in split for w in set(s))
    average = sum(map(len, split)) / len(split)
    for q in range(0, 700, 50):
        scores = []
        for i, s in enumerate(split):
            tf = Counter(s)
            w = sum(np.floor(np.log(1 + (700 - df[x] + 0.5) / (df[x] + 0.5)) * (tf[x] * (search.K1 + 1) / (tf[x] + search.K1 * (1 - search.B + search.B * len(s) / average))) * search.UNIT) for x in set(split[q]) if tf[x])
            scores.append((-w, i))
        assert got[q] == [(i, round(-w)) for w, i in sorted(scores)[:10] if w < 0]


def test_thresholds_rise_without_a_loss(monkeypatch):
    """Several shards of many runs of blocks in one task, with ties: the k best of all are found, and less is handed out than k a shard."""
    monkeypatch.setattr(search, "SHARD_ROWS", 2500)
    rng = random.Random(12)
    words = [f"w{n}" for n in range(300)]
    texts = [" ".join(words[min(int(rng.expovariate(0.03)), 299)] for _ in range(rng.randrange(1, 60))) for _ in range(6000)]
    texts += texts[:900]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    built = list(search.shards(iter([batch])))
    assert len(built) == 3
    average = sum(len(t.split()) for t in texts) / len(texts)
    df = Counter(w for t in texts for w in set(t.split()))
    asked, want = [], []
    for q in range(0, 6900, 460):
        terms = sorted(set(texts[q].split()), key=lambda w: xxhash.xxh64_intdigest(w))
        idf = {w: np.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) for w in terms}
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in terms], np.uint64).view(np.int64)
        asked.append((q, q, hashes, np.array([idf[w] for w in terms]), 0.0))
        scores = []
        for i, t in enumerate(texts):
            found = t.split()
            norm = search.K1 * (1 - search.B + search.B * len(found) / average)
            w = sum(np.floor(idf[x] * (n * (search.K1 + 1) / (n + norm)) * search.UNIT) for x, n in Counter(found).items() if x in idf)
            scores.append((-w, i))
        want.append(sorted(scores)[:10])

    class shared:
        value = asked

    given = defaultdict(list)
    for out in search.searcher(shared, average, 10)(iter(built)):
        for r in out.to_pylist():
            given[r["query_id"]].append((-r["weight"], r["doc_id"]))
    assert [sorted(given[q])[:10] for q, *_ in asked] == want
    assert sum(map(len, given.values())) < 3 * 10 * len(asked)


def test_few_rows_are_handed_out(spark, monkeypatch):
    """However many shards there are: k rows a query from a task, and a few times k rows a query in all."""
    monkeypatch.setattr(search, "SHARD_ROWS", 40)
    rng = random.Random(15)
    words = [f"w{n}" for n in range(400)]
    texts = [" ".join(words[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randrange(30, 60))) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts[:2000])], ["doc_id", "text"])
    terms = [np.unique(np.fromiter((xxhash.xxh64_intdigest(w) for w in set(t.split())), np.uint64)).view(np.int64) for t in texts[:100]]

    class shared:
        value = [(q, q, t, np.ones(len(t)), 0.0) for q, t in enumerate(terms)]

    assert sum(out.num_rows for out in search.searcher(shared, 45.0, 10)(search.shards(iter([batch])))) == 100 * 10

    handed, best = [], search.best
    monkeypatch.setattr(search, "best", lambda found, k: handed.append(found.count()) or best(found, k))
    docs = pairs(spark, list(enumerate(texts))).repartition(50)
    got = search.top_k(docs, docs.filter("doc_id % 50 = 0"), 10).collect()
    assert len(got) == 80 * 10
    assert sum(handed) < 250 * 80, handed


def test_index_rows_are_small(spark, monkeypatch):
    """A shard takes few bytes a posting, and files end their groups of rows after few shards, so that a task holds little of the index."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(search, "SHARD_ROWS", 200)
    rng = random.Random(16)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.002)), 9999)}" for _ in range(100)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
    built = list(search.shards(iter([batch])))
    lists = [len(set(t.split())) for t in texts]
    assert len(built) == 5 and sum(b.nbytes for b in built) < 6 * sum(lists)
    assert sum(sum(b.column("sizes")[0].as_py()) for b in built) == sum(lists)

    monkeypatch.setitem(search.GROUPS, "parquet.block.row.count.limit", 1)
    docs = pairs(spark, list(enumerate(texts))).coalesce(1)
    index = search.stored(docs.mapInArrow(search.shards, search.SHARD))
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    assert sum(g.num_row_groups for g in groups) == sum(g.num_rows for g in groups) == 5


def test_like_rows_become_neighbours():
    rng = np.random.default_rng(3)
    kind = rng.permutation(np.repeat(np.arange(4), 200))
    x = (rng.random((800, 40)) < np.where(np.arange(40) // 10 == kind[:, None], 0.6, 0.02)).astype(np.float32)
    order = search.alike(x, 50)
    assert sorted(order) == list(range(800))
    assert (np.diff(kind[order]) != 0).sum() < 60  # some 600 in the given order
    for odd in (np.zeros((0, 3)), np.zeros((90, 0)), np.ones((90, 5)), np.eye(90)):
        assert sorted(search.alike(odd, 10)) == list(range(len(odd)))


# --- models


def test_gradients():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    x = rng.integers(0, 256, (4, 7))
    x[1, 5:] = x[3, 2:] = language.PAD
    y = np.array([0, 1, 2, 0])

    def loss():
        p, real = net.softmax(net.states(x)), x.T != language.PAD
        return -(np.log(p[:, y, np.arange(4)]) * real).sum() / real.sum()

    grads = net.gradients(x, y)
    for name, a in net.w.items():
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in a.shape)
            if name == "emb":
                at = (at[0], at[1], int(x[0, at[2] % 7]))
            kept = a[at]
            a[at] = kept + 1e-4
            up = loss()
            a[at] = kept - 1e-4
            assert abs((up - loss()) / 2e-4 - grads[name][at]) < 1e-6
            a[at] = kept


def test_held_out(spark):
    docs = table(spark, SF2, "documents").toPandas().merge(table(spark, SF2, "labels").toPandas(), on="doc_id", how="left")
    lang = QUERIES["op1_language_id"](spark, SF2).toPandas().merge(docs, on="doc_id")
    tested = lang[lang.held_out]
    assert (tested.lang_pred == tested.lang).mean() > 0.97 and len(lang) == len(docs)
    quality = QUERIES["op5_quality_ranking"](spark, SF2).toPandas().merge(docs, on="doc_id")
    tested = quality[quality.held_out & quality.quality.notna()]
    assert (tested.predicted == tested.quality).mean() > 0.93
    toxic = QUERIES["op2_toxicity"](spark, SF2).toPandas().merge(docs, on="doc_id")
    tested = toxic[toxic.held_out & toxic.toxic.notna()]
    assert (tested.predicted == tested.toxic).mean() > 0.9
    words = tested.text.str.lower().str.count(r"\b(?:idiot|loser|moron|scum|trash|clown|stupid|pathetic|worthless|disgusting)\b")
    assert tested[words > 2].predicted.mean() > 0.8 and tested[(words == 0) & (tested.toxic == 0)].predicted.mean() < 0.05


def test_kneser_ney_is_a_distribution():
    """With every expression trusted, a class's words sum to one."""
    words = [f"w{n}" for n in range(6)]
    rng = np.random.default_rng(1)
    pairs_ = np.array([(v, w, *rng.integers(0, 9, 2)) for v in range(7) for w in range(7)])
    follows = np.zeros((7, 3), np.int64)
    context = np.zeros((7, 2), np.int64)
    for v, w, a, b in pairs_:
        context[v] += (a, b)
        follows[w] += (a, b, 1)
    kept, toxicity.TRUST = toxicity.TRUST, 0.0
    try:
        model = toxicity.kneser_ney(words, pairs_, context, follows, 0.5)
    finally:
        toxicity.TRUST = kept
    assert len(model.pairs) == 49 and np.isfinite(model.bigram).all()
    assert model.difference("") == 0.0 and model.difference("zzz") == pytest.approx(float(model.bigram[0]), abs=1e-6)


# --- pipeline


def test_pipeline(spark, sf):
    """Each stage on its own input, against a plain version."""
    docs = table(spark, sf, "documents")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        rows = out.collect()
        seen[name] = (at.collect(), rows)
        at = spark.createDataFrame(rows, out.schema)
    given, kept = seen["language_id"]
    assert len(kept) >= 0.98 * sum(1 for r in given if re.search(r"[^\W\d_]", r.text or ""))
    given, kept = seen["near_duplicates"]
    groups = plain_components([(r.doc_id, r.text) for r in given], 5)
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in groups.items() if i == c)
    given, kept = seen["secret_scan"]
    assert len(given) == len(kept)
    for r in kept:
        left = [m for rule in secrets.RULES for m in re.finditer(rule.regex, r.text) if len(m.group(rule.group)) >= rule.least]
        assert not left, r.text
    given, kept = seen["mix"]
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    taken, total = Counter(), Counter()
    for r in kept:
        taken[r.source] += n_words(r.text)
    for r in given:
        total[r.source] += n_words(r.text)
    copies = Counter(r.doc_id for r in kept)
    assert max(copies.values()) <= mixing.CEILING and abs(sum(taken.values()) / sum(total.values()) - 1) < 0.25
    given, out = seen["tokens"]
    assert len(out) == len(given) and all(r.n_tokens == len(r.ids) for r in out)
