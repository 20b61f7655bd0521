"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkquarry.llm import ann, bpe, common, exact_dedup, minhash, packing, secrets, suffix_dedup, token_store, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, shard int"


def table(spark, rows):
    """Rows (doc_id, text), with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], DOCS).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base, passage = prose(rng, 300), prose(rng, 60)
    rows = [(1, None), (2, ""), (3, base), (4, base), (5, base.replace("a", "b", 3)), (6, "é漢字 " * 40), (7, prose(rng, 4000)), (8, "x" * 3000)]
    rows += [(10 + k, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for k in range(8)]
    rows += [(30 + k, base + " " + prose(rng, k)) for k in range(6)] + [(40, "one two"), (41, "ONE  two"), (9, "dup row"), (9, "dup row"), (None, "no id"), (50, "\n \t")]
    return rows


def brute_removed(rows):
    data = [(t or "").encode() for _, t in rows]
    count = {}
    for d in data:
        for j in range(len(d) - 199):
            count[d[j : j + 200]] = count.get(d[j : j + 200], 0) + 1
    out = []
    for (i, _), d in zip(rows, data):
        m = np.zeros(len(d), dtype=bool)
        for j in range(len(d) - 199):
            if count[d[j : j + 200]] > 1:
                m[j : j + 200] = True
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((i, len(d), int(m.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~m])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cap", [4096, 1])
def test_suffix_dedup(spark, corpus, monkeypatch, cap):
    monkeypatch.setattr(suffix_dedup, "CAP", cap)
    got = suffix_dedup.remove_repeats(table(spark, corpus)).collect()
    assert sorted([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], key=repr) == brute_removed(corpus)


def test_suffix_dedup_keeps_first(spark, corpus):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table(spark, [r for r in corpus if r[0] in (3, 4, 10, 11)]), keep="first").collect()}
    assert got[3]["n_removed"] == 0 and got[4]["n_removed"] == got[4]["n_bytes"] and got[10]["n_removed"] == 0 and got[11]["n_removed"] > 200


def test_join_per_key(spark):
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), "id").unionByName(spark.createDataFrame([(None, 900), (7, 901)], "k long, id long"))
    sums = rows.where("k <> 7").groupBy("k").agg(F.count("*").alias("n"))
    joined = common.join_per_key(rows, sums, "k")
    assert joined.columns == ["k", "id", "n"]
    assert sorted(map(tuple, joined.collect())) == sorted((i % 7, i, len(range(i % 7, 200, 7))) for i in range(200))
    merged = common.join_per_key(rows, sums.hint("merge"), "k")._jdf.queryExecution().executedPlan().toString()
    # one exchange for the aggregate and one on either side of the join
    assert merged.count("Exchange hashpartitioning(") == 3 and merged.count("Exchange hashpartitioning(_key") == 2


def test_previous_factors():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, size=600).astype(np.uint8)
    data[300:560] = data[20:280]
    places = np.arange(len(data) - 200)
    order, lcp = suffix_dedup.suffix_order(suffix_dedup.ranks_of(data), places)
    found = suffix_dedup.longest_previous_factor(order, lcp, 1)
    text = data.tobytes()
    for place, best in zip(order.tolist(), found.tolist()):
        want = max((next((n for n in range(200) if text[j + n] != text[place + n]), 200) for j in range(place)), default=0)
        assert best == want


def test_bpe(spark, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = [*corpus, (60, "a <|endoftext|> b  <|endoftext|>"), (61, "it's we'll  \x85  x"), (62, "ab" * 3000)]
    got = {(r["doc_id"], r["text"]): list(array("I", bytes(r["ids"]))) for r in bpe.decode(bpe.encode(table(spark, rows), path), path).collect()}
    for i, t in rows:
        assert got[i, t or ""] == whole.encode(t or "", add_special_tokens=False).ids


def test_token_store(spark, corpus, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    rows = [*corpus, (60, "a <|endoftext|> b"), (61, "İstanbul ΣΑΣ x̌ ǅ it's 3.5%")]
    token_store.write_store(table(spark, rows), path, str(tmp_path / "s"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], list(array("I", bytes(r["ids"])))) for r in token_store.read_store(spark, str(tmp_path / "s")).collect())
    assert len(got) == len(rows) and [g[1] for g in got[1:]] == sorted(i for i, _ in rows if i is not None) and got[0][1] is None
    at = 0
    for start, i, n, ids in got:
        assert start == at and ids in [whole.encode(t or "", add_special_tokens=False).ids + [2] for j, t in rows if j == i]
        at += n
    assert token_store.verify_manifest(spark, str(tmp_path / "s")).isEmpty()


def test_cuts_share_passages():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(3, 49_000, size=n).astype("<u2")
    shared = 0
    for _ in range(200):
        passage, found = draw(900), []
        for _ in range(2):
            ids = np.concatenate([draw(rng.integers(200, 800)), passage, draw(rng.integers(200, 800))])
            ends = token_store.cuts(ids)
            assert ends[-1] == len(ids) and all(b - a <= token_store.MOST for a, b in zip([0, *ends], ends))
            found.append({ids[a:b].tobytes() for a, b in zip([0, *ends], ends)})
        shared += sum(len(c) // 2 for c in found[0] & found[1])
    assert shared > 0.2 * 900 * 200


def test_exact_dedup(spark, corpus):
    got = exact_dedup.exact_groups(table(spark, corpus)).collect()
    assert len(got) == len(corpus)
    by_digest = {}
    for i, t in corpus:
        by_digest.setdefault(hashlib.sha256((t or "").encode()).digest(), []).append(i)
    for r in got:
        ids = by_digest[bytes(r["digest"])]
        assert (r["keep_id"], r["group_size"]) == (max((i for i in ids if i is not None), default=None), len(ids))
    kept = [r["doc_id"] for r in exact_dedup.unique_documents(table(spark, corpus)).collect()]
    assert len(kept) == len(by_digest) and 4 in kept and 3 not in kept and kept.count(9) == 1
    new = exact_dedup.against_history(table(spark, [(100, "dup row"), (101, "fresh"), (102, "fresh")]), table(spark, corpus)).collect()
    assert {r["doc_id"]: r["keep_id"] for r in new} == {100: 9, 101: 102, 102: 102}


def test_exact_dedup_against_long_history(spark):
    past = [(i, f"old {i}") for i in range(3000)] + [(5000 + i, "often") for i in range(40)]
    for extra in (0, 1500):
        batch = [(10000 + i, f"old {i}") for i in range(0, 3000, 6)] + [(20000 + i, f"new {i // 2}") for i in range(100 + extra)] + [(30000 + i, "hot") for i in range(30)] + [(40000, "often"), (None, "idless")]
        last, size = {t: i for i, t in batch}, {}
        for _, t in batch:
            size[t] = size.get(t, 0) + 1
        last |= {t: i for i, t in past}
        size |= {t: 40 if t == "often" else 1 for _, t in past}
        got = exact_dedup.against_history(table(spark, batch), table(spark, past)).collect()
        text = {hashlib.sha256(t.encode()).digest(): t for _, t in batch}
        assert len(got) == len(batch)
        assert all((r["keep_id"], r["group_size"]) == (last[text[bytes(r["digest"])]], size[text[bytes(r["digest"])]]) for r in got)


def test_exact_dedup_uses_the_index(spark, monkeypatch):
    """With no digest frequent enough to be broadcast, every answer comes from a slot of the index, and hot ones pass through it once as well."""
    built, asked = [], []
    build, find = exact_dedup.build_history, exact_dedup.lookup
    monkeypatch.setattr(exact_dedup, "build_history", lambda winners, n: (built.append(winners.count()), build(winners, n))[1])
    monkeypatch.setattr(exact_dedup, "lookup", lambda own, index, n: (asked.append(find(own, index, n).where("member").count()), find(own, index, n))[1])
    past = [(i, f"old {i}") for i in range(3000)]
    for hot in (1, 10**9):
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot)
        got = exact_dedup.against_history(table(spark, [(9000 + i, f"old {i}") for i in range(900)] + [(1, "hot")] * 50), table(spark, past)).collect()
        assert len(got) == 950 and sum(r["keep_id"] < 900 and r["doc_id"] >= 9000 for r in got) == 900 and all(r["group_size"] == 50 for r in got if r["doc_id"] == 1)
    assert built == [3000, 3000] and asked == [900, 900]


def test_unique_documents_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 7, 8), (2, "a", 7, 8), (3, None, 9, 1), (4, "", 2, 2)], "doc_id long, text string, _own0 long, _own1 long")
    assert sorted(map(tuple, exact_dedup.unique_documents(docs).collect())) == [(2, "a", 7, 8), (4, "", 2, 2)]
    assert sorted(map(tuple, minhash.one_of_each(docs.dropDuplicates(["doc_id"])).select("doc_id", "_own0").collect())) == [(1, 5), (3, 9), (4, 2)]


def test_minimal_perfect_hash():
    digests = np.array([hashlib.sha256(str(i).encode()).digest() for i in range(5000)], dtype=object)
    words = exact_dedup._words(digests)
    levels, slots = exact_dedup.build_levels(words[:3000])
    assert sorted(slots.tolist()) == list(range(3000)) and exact_dedup.slots_of(levels, words[:3000]).tolist() == slots.tolist()
    assert exact_dedup.slots_of(levels, words[3000:]).max() < 3000


def brute_components(rows, words, p, q):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if inter and q * inter >= p * (len(sets[a]) + len(sets[b]) - inter) and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,threshold,block", [(3, (85, 100), 512), (5, (80, 100), 512), (3, (85, 100), 2)])
def test_minhash(spark, corpus, monkeypatch, words, threshold, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_groups(table(spark, corpus), words, threshold).collect()
    want = brute_components(corpus, words, *threshold)
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_large_buckets_tie_every_seat(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    # documents 1 to 9 share key 1, documents 5 to 20 key 2; sketches are all incompatible, so only the ties of large buckets are left
    rng = np.random.default_rng(8)
    rows = [(i, [1] * (i < 10) + [2] * (i > 4), rng.bytes(minhash.BITS // 8)) for i in range(1, 21)]
    found = spark.createDataFrame(rows, "doc_id long, keys array<long>, sketch binary")
    got = {(r["a"], r["b"]) for r in minhash.bucket_ties(found, found, 0.99, 1000).collect()}
    assert got == {(1, i) for i in range(2, 10)} | {(5, i) for i in range(6, 21)}


@pytest.mark.parametrize("block", [5, 512])
def test_large_groups_are_confirmed_in_rounds(spark, monkeypatch, block):
    """Near copies, two families that only candidates tie together, a chain, and lone documents beside them, all in groups of many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(21)
    base, other = prose(rng, 120).split(), prose(rng, 40).split()
    change = lambda words, n: " ".join([x if k not in rng.sample(range(len(words)), n) else "zz" + x for k, x in enumerate(words)])
    rows = [(100 + k, change(base, rng.choice([0, 1, 2]))) for k in range(40)] + [(200 + k, change(base[:80] + other, 1)) for k in range(15)]
    rows += [(300 + k, " ".join(base[3 * k :] + other[: 3 * k])) for k in range(12)] + [(400 + k, change(base, 12)) for k in range(8)]
    want = brute_components(rows, 3, 85, 100)
    docs = table(spark, rows)
    for groups in (None, [(i, 100) for i, _ in rows]):
        if groups is None:
            got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs, 3, (85, 100)).collect()}
        else:  # one candidate group of everything
            digest = {r["doc_id"]: r["digest"] for r in minhash.sketch_documents(docs, 3).collect()}
            heads = {}
            for i, _ in rows:
                heads.setdefault(bytes(digest[i]), i)
            nodes = spark.createDataFrame([(i, 100, digest[i]) for i in heads.values()], "node long, component long, digest binary")
            links = {r["node"]: r["component"] for r in common.connected_components(minhash.confirmed(docs, nodes, 3, (85, 100))).collect()}
            got = {i: min(links.get(heads[bytes(digest[i])], heads[bytes(digest[i])]), i) for i, _ in rows}
        assert got == {i: c for i, (_, c) in want.items()}
    assert len(set(got.values())) > 5


def test_near_groups_of_repeated_ids(spark):
    rng = random.Random(2)
    a, b = prose(rng, 50), prose(rng, 50)
    got = minhash.near_groups(table(spark, [(5, a), (5, b), (5, b), (6, a), (7, b), (8, None), (8, "one two three four"), (9, "")]), 3, (85, 100)).collect()
    assert len(got) == 8 and {r["component_id"] for r in got if r["doc_id"] == 5} == {5} and all(r["component_id"] <= r["doc_id"] for r in got)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (6, 7)} in ({6: 5, 7: 7}, {6: 6, 7: 5})
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 8) == [0, 2]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(2)
    a, b = minhash.samplers(minhash.ROWS, minhash.BANDS)
    for same in (700, 900):
        x = rng.integers(0, 2**63, size=1000, dtype=np.int64).astype(np.uint64)
        y = np.concatenate([x[:same], rng.integers(0, 2**63, size=1000 - same, dtype=np.int64).astype(np.uint64)])
        s = [np.frombuffer(minhash.odd_sketch(minhash.minhash(np.unique(v), a, b)), np.uint64) for v in (x, y)]
        got = minhash.estimate(np.bitwise_count(s[0] ^ s[1]).sum(), minhash.ROWS * minhash.BANDS)
        assert got == pytest.approx(same / (2000 - same), abs=0.1)


def test_sketches_of_many_sets_at_once(spark, monkeypatch):
    """Minima, keys and sketches of sets that share passes, or need several, are those of each set alone."""
    rng = np.random.default_rng(4)
    a, b = minhash.samplers(minhash.ROWS, minhash.BANDS)
    sets = [np.unique(rng.integers(0, 2**63, size=n, dtype=np.int64).astype(np.uint64)) for n in (1, 7, 1, 300, 12, 64, 1, 5)]
    for together in (1, 5, 64, 65_536):
        monkeypatch.setattr(minhash, "TOGETHER", together)
        got = minhash.minhashes(sets, a, b)
        for x, one in zip(got, sets, strict=True):
            y = (one >> np.uint64(32)).astype(np.uint32) * a + b
            assert (x == (y ^ (y >> np.uint32(15))).min(axis=1)).all()
    for x, key, sketch in zip(got, minhash.band_keys(got, minhash.ROWS, minhash.BANDS), minhash.odd_sketches(got), strict=True):
        assert (key == minhash.band_keys(x[None], minhash.ROWS, minhash.BANDS)[0]).all() and sketch == minhash.odd_sketch(x)
        flips = np.zeros(minhash.BITS, dtype=int)
        for n, value in enumerate(x.tolist()):
            flips[int(common.mix64(np.array([n << 32 | value], dtype=np.uint64))[0]) % minhash.BITS] ^= 1
        assert sketch == np.packbits(flips).tobytes()
    # rows without text lie between the others and keep their places
    prng = random.Random(6)
    texts = {k: None if k % 5 == 0 else prose(prng, 4 + k) for k in range(40)}
    rows = {r["doc_id"]: r for r in minhash.sketch_documents(table(spark, list(texts.items())), 3).collect()}
    assert rows.keys() == texts.keys()
    for k, text in texts.items():
        one = minhash.shingles(text or "", 3)
        assert rows[k]["n_shingles"] == len(one)
        assert (rows[k]["digest"], rows[k]["sketch"]) == ((minhash.set_digest(one.tobytes()), minhash.odd_sketch(minhash.minhash(one, a, b))) if len(one) else (None, None))


def test_links_of_small_groups_cost_their_sets():
    """Two documents are compared in arrays of their own size."""
    rng = np.random.default_rng(9)
    x = np.unique(rng.integers(0, 2**63, size=200, dtype=np.int64).astype(np.uint64))
    tracemalloc.start()
    try:
        assert list(minhash.links([x, x[:190]], (85, 100))) == [(0, 1)] and list(minhash.links([x, x[:100]], (85, 100))) == []
        assert list(minhash.links([x[:100], x[100:]], (85, 100))) == [] and list(minhash.links([x, x[:190], x[5:]], (85, 100), 1)) == [(0, 1), (0, 2)]
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()


def test_secrets(spark):
    rows = [(1, None), (2, 'x token = "abcdefgh12" y'), (3, "API_KEY: short"), (4, "AKIA" + "A1" * 8), (5, "0123456789abcdef" * 2), (6, 'k = "Zx9kQ2mP7vL1"\npassword = k\n'), (7, "token: token: abcdefghij"), (8, "a: b = c"), (9, 'tokeﬀn = "abcdefghij" ſecret=abcdefghijk')]
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in secrets.scan_documents(table(spark, rows)).collect()}
    assert got[1] == [] and got[2][0] == ("assign", 2, 21) and got[3] == [] and got[4] == [("access", 0, 20)] and got[5] == [("hex", 0, 32)] and got[8] == []
    assert [x for x in got[7] if x[0] in secrets.KINDS] == []
    assert ("constant", 5, 17) in got[6] and [x for x in got[9] if x[0] in secrets.KINDS] == []
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_documents(table(spark, rows)).collect()}
    assert masked[1] is None and "abcdefgh12" not in masked[2] and "Zx9k" not in masked[6] and masked[8] == "a: b = c"


@pytest.mark.parametrize(
    "text",
    [
        'password: str = "Zx9kQ2mP7vL1"', 'const apiKey: string = "Zx9kQ2mP7vL1";', 'var password string = "Zx9kQ2mP7vL1"', '\tpassword string = "Zx9kQ2mP7vL1"', 'const token pkg.Kind = "Zx9kQ2mP7vL1"',
        'password: Optional[dict[str, list[str]]] = "Zx9kQ2mP7vL1"', "let password: &'static str = \"Zx9kQ2mP7vL1\";", 'secret: string | undefined = "Zx9kQ2mP7vL1"', 'auth_token: std::string = "Zx9kQ2mP7vL1"',
        "password" + " " * 90 + '= "Zx9kQ2mP7vL1"', "db_password_" + "x" * 85 + ' = "Zx9kQ2mP7vL1"', 'K="Zx9kQ2mP7vL1"\nPASSWORD=$K\n', 'K="Zx9kQ2mP7vL1"\nexport PASSWORD="${K}"\n', "k: Zx9kQ2mP7vL1\npassword: ${k}\n",
        'note: password = "Zx9kQ2mP7vL1"', 'x["password"] = "Zx9kQ2mP7vL1"', "'api key': 'Zx9kQ2mP7vL1'",
    ],
)
def test_secrets_of_common_syntax(text):
    at = text.index("Zx9k")
    assert (at, at + 12) in [(s, e) for s, _, e in secrets.method_spans(text)]
    assert "Zx9k" not in secrets.masked(text)


def test_secrets_joined_from_parts():
    found = lambda text: [text[a:b] for a, _, b in secrets.method_spans(text)]
    assert found('password = "Zx9k" + "Q2mP" + "7vL1"') == ["Zx9k", "Q2mP", "7vL1"]
    assert found('A = "Zx9kQ2"\nB="mP7vL1"\nsecret_key = A + B\n') == ["Zx9kQ2", "mP7vL1"]
    assert found("$password = 'Zx9kQ2' . 'mP7vL1';") == ["Zx9kQ2", "mP7vL1"] and found('password = "abc" .. "d"') == []
    assert found('password = "Zx9kQ2mP7vL1" + os.environ') == ["Zx9kQ2mP7vL1"]
    assert len(found('a = "Zx9kQ2mP7vL1"\n' + "a = a + a\n" * 300 + "password = a")) == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("PASSWORD='''Zx9kQ2\nmP7vL1'''", ["Zx9kQ2\nmP7vL1"]), ('token = """Zx9kQ2mP7vL1"""', ["Zx9kQ2mP7vL1"]), ('passwords = [\n  "Zx9kQ2mP7vL1",\n  \'Ab9kQ2mP7vL1\',\n]', ["Zx9kQ2mP7vL1", "Ab9kQ2mP7vL1"]),
        ("a:\n  secret: |\n    Zx9kQ2mP\n    7vL1abcd\n  other: 5", ["Zx9kQ2mP", "7vL1abcd"]), ('conn.setPassword("Zx9kQ2mP7vL1")', ["Zx9kQ2mP7vL1"]), ('password = f"Zx9kQ2mP7vL1"', ["Zx9kQ2mP7vL1"]),
        ('password = os.environ["HOME_DIR_X9"]', []), ("password = getpass.getpass_q9()", []), ('password = "<none>" + "Zx9kQ2mP7vL1"', []), ('password = "exam" + "pleZx9kQ2mP7vL1"', []),
    ],
)
def test_secrets_of_more_syntax(text, want):
    assert [text[a:b] for a, _, b in secrets.method_spans(text)] == want


def test_secrets_of_very_long_values():
    many = "password = " + " + ".join(f'"Zx{k:05d}q"' for k in range(5000))
    assert len(secrets.method_spans(many)) == 5000 and "Zx" not in secrets.masked(many)
    chain = 'a = "Zx9kQ2mP7vL1"\n' + 'a = a + "k9"\n' * 20_000 + "password = a"
    assert len(secrets.method_spans(chain)) == 20_001
    for text in ("x=" * 200_000, "a:" * 200_000, "x='" * 100_000, 'password = "' + "<" * 1_000_000 + '"', 'a = "Zx9k"\n' + "a = a + a\n" * 20_000, " " * 1_000_000 + "="):
        assert secrets.method_spans(text) == []  # in seconds: each of these took minutes in quadratic time
    # values that hold each other are scored like the slices they are
    text = "password=Zx9kQ2=token=mP7vL1aB=salt=changeme9"
    assert [text[a:b] for a, _, b in secrets.method_spans(text)] == []
    text = "password=Zx9kQ2=token=mP7vL1aB=salt=q0w9e8r7"
    assert [text[a:b] for a, _, b in secrets.method_spans(text)][:2] == [text[9:], text[22:]]


def test_value_traits_of_joins():
    rng = random.Random(2)
    for _ in range(300):
        parts = ["".join(rng.choices(["a", "B", "3", "x", "<", ">", "$", "{", "your_", "exam", "ple", "*", " "], k=rng.randint(0, 6))) for _ in range(rng.randint(1, 6))]
        whole = "".join(parts)
        joined = secrets.Traits.of(parts[0])
        for p in parts[1:]:
            joined = joined + secrets.Traits.of(p)
        assert joined.score() == pytest.approx(secrets.Traits.of(whole).score()) and joined.placeholder == secrets.Traits.of(whole).placeholder


def test_secrets_leave_others_alone():
    for text in ("K='Zx9kQ2mP7vL1'\nPASSWORD='$K'\n", "PASSWORD=$K", "PASSWORD=${K}", 'secret sauce = "Zx9kQ2mP7vL1"', 'name: str = "Zx9kQ2mP7vL1"', 'String colour = "Zx9kQ2mP7vL1"', "password: str", "a: b[[[[<<<< = c"):
        assert secrets.method_spans(text) == []


def test_url_filter(spark):
    urls = ["https://www.Foo.example.net/en/1?x", "http://a.net", "http://a.net/", "http://x.example.com/de/1", "http://q.org/fr/", "http://nnet/", None, "nothing", "http://cheap-pills.example.com/en/5", "http://library.example.com/en/5"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = url_filter.train(url_filter.labelled_table())
    got = {r["page_id"]: r for r in url_filter.judge(pages, model).collect()}
    assert [got[k]["rule"] for k in range(8)] == ["example.net/en/", None, "net/", "example.com/de/", "org/fr/", None, None, None]
    assert [got[k]["verdict"] for k in (0, 2, 3, 4, 8, 9)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert (got[0]["host"], got[0]["path"], got[6]["host"], got[7]["path"]) == ("www.foo.example.net", "/en/1", "", "")
    for k, u in enumerate(urls):
        assert (got[k]["host"], got[k]["path"]) == url_filter.split_url(u)


def test_url_model_on_held_out_hosts_and_paths():
    """Hosts and paths that training has not seen, and paths that alone decide."""
    table, all_hosts, all_paths = [(*url_filter.split_url(u), u, y) for u, y in url_filter.labelled_table()], *url_filter.labelled_parts()
    right = total = 0
    for part in range(5):
        hosts, paths = {h for h, _ in all_hosts[part::5]}, {p for p, _ in all_paths[part::5]} - {"/"}
        model = url_filter.train([(u, y) for h, p, u, y in table if h not in hosts and p not in paths])
        left = [(h, p, y) for h, p, _, y in table if h in hosts]
        got = url_filter.scores([h for h, _, _ in left], [p for _, p, _ in left], *model) >= 0.5
        right, total = right + int(sum(g == y for g, (_, _, y) in zip(got, left))), total + len(left)
    assert right / total > 0.95, right / total
    model = url_filter.train(url_filter.labelled_table())
    bad = ["http://www.neutral.example.org/casino-win-free-pills", "http://files.example.com/cheap-viagra-pills", "http://casino-bonus-club.example.org/en/5"]
    good = ["http://www.neutral.example.org/library/opening", "http://files.example.com/docs/guide", "http://www.gardening.example.org/en/5", "http://example.org/"]
    assert (url_filter.scores(*map(list, zip(*map(url_filter.split_url, bad + good))), *model) >= 0.5).tolist() == [True] * 3 + [False] * 4


def test_url_filter_edges(spark):
    schema = "page_id long, url string, host string, score double"
    model = url_filter.train(url_filter.labelled_urls(spark.createDataFrame([("http://a.example.com/x", 1), ("b.example.com/y", 0), (None, 1), ("c", None)], "url string, label int")))
    assert url_filter.judge(spark.createDataFrame([], schema), model).isEmpty()
    long_url = "http://h.example.com/" + "ab" * 900_000
    rows = [(1, long_url, "x", 0.0), (2, "http://a.example.com/x", None, None), (2, "http://a.example.com/x", None, None), (None, "", "y", 1.0)]
    got = url_filter.judge(spark.createDataFrame(rows, schema), model).collect()
    assert len(got) == 4 and len({(r["page_id"], r["verdict"], r["score"]) for r in got if r["page_id"] == 2}) == 1 and next(r for r in got if r["page_id"] == 1)["path"] == long_url[20:]
    assert url_filter.train([])[1] < 0


def test_packing(spark, corpus):
    docs = table(spark, [*corpus, (70, "w " * 9000)])
    got = packing.pack(docs, packing.word_length(F.coalesce("text", F.lit("")))).collect()
    total = {}
    for r in got:
        total.setdefault((r["shard"], r["bin"]), []).append(r)
    for rows in total.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        cap = rows[0]["capacity"]
        assert rows[0]["bin_used"] == at <= cap and cap in packing.CAPACITIES and not any(at <= c < cap for c in packing.CAPACITIES)
    assert sum(r["length"] for r in got if r["doc_id"] == 70) == 9001 and len([r for r in got if r["doc_id"] == 1]) == 1


def unpacked(sequences):
    """(doc_id, ids) of the documents in rows of sequences, whose boundaries and padding are checked. Rows that repeat a doc_id count as the pieces say."""
    pieces = []
    for r in sequences:
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u2").tolist()
        assert len(ids) == r["capacity"] in packing.CAPACITIES and not any(r["used"] <= c < r["capacity"] for c in packing.CAPACITIES) and set(ids[r["used"] :]) <= {50256}
        assert r["starts"] == [sum(r["lengths"][:k]) for k in range(len(r["lengths"]))] and sum(r["lengths"]) == r["used"]
        pieces += [(d, p, ids[a : a + n]) for d, p, a, n in zip(r["doc_ids"], r["pieces"], r["starts"], r["lengths"], strict=True)]
    out, waiting = [], {}
    for d, p, ids in sorted(pieces, key=lambda x: (repr(x[0]), x[1], x[2])):
        waiting.setdefault(d, {}).setdefault(p, []).append(ids)
    for d, by_piece in waiting.items():
        for k in range(len(by_piece[0])):  # alike rows of one id have alike pieces
            out.append((d, [x for p in sorted(by_piece) if k < len(by_piece[p]) for x in by_piece[p][k]]))
    return sorted(out, key=repr)


def brute_best_fit(lengths, capacities, overhead, price=None):
    """The rule in words: longest first into the open bin with the least room that still holds it (ties: the older); else a new bin of the least cost per expected unit."""
    lengths, bins = sorted(lengths, reverse=True), []
    for k, n in enumerate(lengths):
        open_ = [(room, b) for b, (room, _) in enumerate(bins) if room >= n]
        if open_:
            b = min(open_)[1]
        else:
            cost = lambda c: ((price or (lambda c: c + overhead))(c)) / (n + min(c - n, sum(x for x in lengths if x <= c - n), sum(lengths[k + 1 :])))
            bins.append((min((cost(c), c) for c in capacities if c >= n)[1], []))
            b = len(bins) - 1
        bins[b] = bins[b][0] - n, [*bins[b][1], n]
    return [(held, min(c for c in capacities if c >= sum(held))) for _, held in bins]


def test_best_fit_against_brute_force():
    rng = random.Random(5)
    for trial in range(60):
        capacities = (16, 32, 64)
        lengths = sorted((rng.randint(1, rng.choice([6, 30, 64])) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, starts, sizes = packing.best_fit(lengths, capacities, 3)
        held = {}
        for n, b, at in zip(lengths, bins, starts, strict=True):
            assert at == sum(held.setdefault(b, []))
            held[b].append(n)
        assert [(held[b], sizes[b]) for b in range(len(sizes))] == brute_best_fit(lengths, capacities, 3), trial
    # cheaper than any one capacity alone
    lengths = sorted((rng.choice([3, 9, 20, 33, 50]) for _ in range(400)), reverse=True)
    cost = lambda sizes: sum(c + 3 for c in sizes)
    assert cost(packing.best_fit(lengths, (16, 32, 64), 3)[2]) <= cost(packing.best_fit(lengths, (64,), 3)[2])
    # where cost grows with the square, as attention does, several capacities are in use and beat each one that holds all pieces
    lengths = sorted((min(4096, int(rng.lognormvariate(5.6, 1.1)) + 1) for _ in range(5000)), reverse=True)
    cost = lambda sizes: sum(c * (1 + c / packing.ATTENTION) + packing.OVERHEAD for c in sizes)
    mixed = packing.best_fit(lengths, attention=packing.ATTENTION)[2]
    assert min(Counter(mixed).values()) > 5 and len(set(mixed)) == 4
    assert cost(mixed) < 0.95 * cost(packing.best_fit(lengths, (4096,), attention=packing.ATTENTION)[2])


def test_packing_counts_pieces_and_breaks_ties(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 10)
    got = packing.pack(table(spark, [(1, "w " * 4096 * 60), (2, "w " * 90), (3, "w " * 90), (3, "w " * 90), (None, "w")]), packing.word_length(F.coalesce("text", F.lit("")))).collect()
    assert len({r["shard"] for r in got}) > 3 and sum(r["length"] for r in got if r["doc_id"] == 1) == 4096 * 60 + 1 and len(got) == 65
    lone = packing.pack(table(spark, [(3, "w " * 90), (2, "w " * 90), (1, "w " * 90)]), packing.word_length(F.col("text"))).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in lone] == [(1, 0), (2, 91), (3, 182)]


def test_ann(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[500:900] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (None, [1.0] * 16)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = v.astype(np.float64)
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
        score = unit @ unit[q]
        score[q] = -9
        hits += sum(s >= np.sort(score)[-5] - 1e-12 for _, _, s in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [f[1] for f in sorted(got[0])] == [500, 501, 502, 503, 504]


def brute_nearest(rows, k=5):
    """query -> the k nearest ids and scores, by the whole matrix; rows: unique ids and usable vectors."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    unit, out = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for at in np.flatnonzero(ids % 50 == 0).tolist():
        score = unit @ unit[at]
        order = [j for j in np.lexsort((ids, -score)).tolist() if j != at][:k]
        out[int(ids[at])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ann_recall_on_embeddings(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want, hits = brute_nearest(rows), 0
    got = ann.op3_permutation_index(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == 5 * len(want)
    vectors = dict(rows)
    for r in got:
        a, b = np.array(vectors[r["query_id"]], dtype=np.float64), np.array(vectors[r["vec_id"]], dtype=np.float64)
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12) and r["vec_id"] != r["query_id"]
        hits += r["score"] >= want[r["query_id"]][-1][1] - 1e-12
    assert hits >= 0.95 * len(got), hits / len(got)


def test_ann_repeated_ids_and_ties(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)] + [(7, [1.0] + [0.0] * 7)] * 6 + [(50, [1.0] + [0.01] * 7), (60, [2.0] + [0.0] * 7), (61, [4.0] + [0.0] * 7), (100, None)]
    got = {}
    table_ = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, key long, v string")
    for r in ann.nearest(table_, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    least = {}
    for i, v in rows:
        if v is not None:
            least[i] = min(v, least.get(i, v))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in brute_nearest(list(least.items())).items()}
    assert [i for _, i in sorted(got[50])][:2] == [60, 61]
    few = ann.nearest(table_.where("vec_id in (50, 60, 61)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 60), (2, 61)]


def test_toxicity_bounds_what_it_trains_on(spark):
    rows = [(1, "good day. " * 10), (1, "good day. " * 10), (2, "bad bad. " * 2000), (3, None), (4, ""), (5, "vile thing."), (5, "another text."), (None, "no id")]
    labels = spark.createDataFrame([(i, int(i == 5)) for i in range(1, 6)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    used = [i for i in range(1, 6) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(toxicity.training_rows(table(spark, rows), labels)) == len(used)
    assert len(toxicity.training_rows(table(spark, rows), labels, most_bytes=2000)) == len([i for i in used if i != 2])
    assert len(toxicity.training_rows(table(spark, rows), labels, bound=2)) == 2 and toxicity.training_rows(table(spark, rows), labels.limit(0)) == []
    got = toxicity.score_documents(table(spark, rows), toxicity.fit(table(spark, rows), labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = spark.createDataFrame([(None,), (1,)], "d long").select(toxicity.held_out(F.col("d"))).collect()
    assert held[0][0] is False


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(1)
    rows, labels = [(9999, None), (9998, "")], []
    for i in range(900):
        bad = i % 6 == 0
        words = [prose(rng, 8) for _ in range(5)]
        if bad:
            words[2] += " vilezzz" + rng.choice("abc")
        rows.append((i, ". ".join(words) + "."))
        labels.append((i, 0, int(bad)))
    docs, model = table(spark, rows), None
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i]["score"] >= 0.3) == (i % 6 == 0) for i in held]) > 0.97
    assert got[9999]["score"] == got[9998]["score"] < 0.3
    text = dict(rows)
    assert np.mean(["vilezzz" in text[i][got[i]["worst_start"] : got[i]["worst_end"]] for i in held if i % 6 == 0 and got[i]["score"] >= 0.3]) > 0.9
    assert toxicity.clean_documents(docs, model).count() == sum(r["score"] < 0.3 for r in got.values())


def test_empty_tables(spark, tmp_path):
    docs = table(spark, []).limit(0)
    assert suffix_dedup.remove_repeats(docs).isEmpty() and exact_dedup.exact_groups(docs).isEmpty() and minhash.near_groups(docs).isEmpty()
    assert secrets.scan_documents(docs).isEmpty() and packing.pack(docs, F.lit(1)).isEmpty()
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).isEmpty()
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write_store(docs, path, str(tmp_path / "e"))
    assert token_store.read_store(spark, str(tmp_path / "e")).isEmpty()
    assert toxicity.score_documents(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).isEmpty()


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    cache, last, want = model.cache(), {}, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        if model.score(model.sentences(r["text"] or "", cache)) < 0.3:
            last[r["text"] or ""] = r["doc_id"]
    groups = brute_components([(i, t) for t, i in last.items()], 5, 80, 100)
    for t, i in last.items():
        if groups[i][1] == i:
            want[i] = secrets.masked(t)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    got = unpacked(corpus_pipeline.run(spark, sf).collect())
    assert all(ids[-1] == 50256 for _, ids in got)
    assert [(i, ids[:-1]) for i, ids in got] == sorted(((i, whole.encode(t, add_special_tokens=False).ids) for i, t in want.items()), key=repr)
    assert {i: whole.decode(ids[:-1]) for i, ids in got} == want  # the cleaned and masked texts are in the result
