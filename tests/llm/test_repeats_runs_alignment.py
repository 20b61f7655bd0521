"""op11 to op13 against brute force on hostile rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables, odd white space."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkquarry.llm import align, entries, periodic, windows

from .test_llm import prose, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(77)
    base, passage = prose(rng, 300), prose(rng, 60)
    out = [(1, None), (2, ""), (3, base), (4, base), (4, base), (5, base.replace("a", "b", 3)), (None, passage), (None, passage), (None, None), (6, "é漢字 \u3000x\x85y " * 40), (7, prose(rng, 6000)), (8, "x" * 3000), (9, "\n \t")]
    out += [(10 + k, prose(rng, 30) + "  " + passage + "\n\n " + prose(rng, 30)) for k in range(8)] + [(-5, passage), (2**60 + 1, passage), (2**60 + 2, prose(rng, 20)), (20, " ".join(passage.split()[:13])), (21, " ".join(passage.split()[1:13]))]
    out += [(30 + k, ("a b c " * k + "d ") * 3) for k in range(12)] + [(50, "w " * 400), (51, "a ▁ b"), (52, "<|endoftext|> <s> <0x41> \x00 \ufeff zero\u200b"), (53, "  two  spaces   and\ttabs \r\n end "), (54, "ﬀ ½ 👩‍👩‍👧 e\u0301")]
    return out


def write(spark, rows, folder):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    return write(spark, rows, tmp_path_factory.mktemp("hostile"))


def found(spark, folder, name):
    return sorted((tuple(r) for r in entries.QUERIES[name](spark, folder).collect()), key=repr)


def brute_windows(rows, width):
    number = lambda i: 2**63 - 1 if i is None else i
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, number(i)), number(i))
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < number(i):
                gone[k : k + width] = [True] * width
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)


def test_op11(spark, folder, rows):
    assert found(spark, folder, "op11_substring_dedup") == sorted(((i, n, k, sha(t)) for i, n, k, t in brute_windows(rows, 13)), key=repr)


@pytest.mark.parametrize("width", [1, 3, 30])
def test_windows_of_other_widths(spark, rows, monkeypatch, width):
    monkeypatch.setattr(windows, "SEGMENT_WORDS", 50)
    got = sorted(((r[0], r[1], r[2], bytes(r[3]).decode()) for r in windows.remove_repeats(table(spark, rows), width).collect()), key=repr)
    assert got == sorted(brute_windows(rows, width), key=repr) and len(windows.ladder(width)) == {1: 1, 3: 1, 30: 4}[width]


def test_windows_without_repeats_end_early(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, 40)) for k in range(5)]
    got = windows.remove_repeats(table(spark, rows), 13).collect()
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in got} == dict(rows)
    assert windows.remove_repeats(table(spark, []), 13).isEmpty()


def brute_runs(w, least, times):
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, times * q) and not any(all(w[x] == w[x + r] for x in range(s, e - r)) for r in range(1, q)):
                out.add((s, e - s, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_op12(spark, folder, rows):
    want = []
    for i, t in rows:
        w, h = WORDS.findall(t or ""), zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w, 6, 4)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)), n))
    assert found(spark, folder, "op12_periodic_runs") == sorted(want, key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i is not None and t)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_runs_of_made_words(least, times):
    rng = random.Random(least)
    for _ in range(200):
        docs = []
        for _ in range(rng.randint(0, 3)):
            d = []
            for _ in range(rng.randint(0, 5)):
                unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
                d += (unit * rng.randint(1, 9))[: rng.randint(1, 40)] if rng.random() < 0.6 else [rng.randint(0, 30) for _ in range(rng.randint(0, 9))]
            docs.append(d)
        starts = np.concatenate(([0], np.cumsum([len(d) for d in docs], dtype=np.int64))).astype(np.int64)
        got = [tuple(r) for r in periodic.runs_of(np.array([x for d in docs for x in d], dtype=np.int64), starts, least, times).tolist()]
        assert got == [(s + o, s + m + o, q) for d, o in zip(docs, starts.tolist()) for s, m, q in brute_runs(d, least, times)]
    # one long run, and a long text whose k-grams all repeat without a run
    assert periodic.runs_of(np.zeros(200_000, dtype=np.int64), np.array([0, 200_000]), 6, 4).tolist() == [[0, 200_000, 1]]
    twice = np.tile(np.arange(50_000), 2)
    assert len(periodic.runs_of(twice, np.array([0, len(twice)]), 6, 4)) == 0
    assert [periodic.least_overlap(*x) for x in ((6, 4), (2, 2), (9, 3))] == [5, 1, 6]


def token_bytes():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(256 + more), more + 1
    byte_of = {c: b for b, c in letters.items()}
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of_a = {i: bytes(byte_of[c] for c in t) for t, i in whole.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in t)}
    of_b = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    return whole, pieces, of_a, of_b


def brute_alignment(rows):
    whole, pieces, of_a, of_b = token_bytes()
    each, times = [], Counter()
    for i, t in rows:
        a, b = (whole.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)) if t else ([], [])
        bytes_a, bytes_b = [of_a[x] for x in a], [of_b(x) for x in b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            each.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(a[j], b[k]) for j in range(len(a)) for k in range(len(b)) if max(ends_a[j] - len(bytes_a[j]), ends_b[k] - len(bytes_b[k])) < min(ends_a[j], ends_b[k])] if len(a) < 2000 else None
        if links is None:  # the same by two pointers, for long texts
            links, j, k = [], 0, 0
            while j < len(a):
                links.append((a[j], b[k]))
                j, k = j + (ends_a[j] <= ends_b[k]), k + (ends_b[k] <= ends_a[j])
        groups, last = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([x for x, e in zip(a, ends_a) if last < e <= cut], [x for x, e in zip(b, ends_b) if last < e <= cut]) if len(a) < 2000 else None)
            last = cut
        times.update(links)
        each.append((i, a, b, groups, links))
    highest = defaultdict(int)
    for (_, y), n in times.items():
        highest[y] = max(highest[y], n)
    return [(i, len(a), len(b), len(g), len(x), sum(times[p] == highest[p[1]] for p in x), sum(times[p] for p in x), "" if not a else sha(";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g)) if g[0] else None) for i, a, b, g, x in each]


def test_op13(spark, folder, rows):
    got, want = found(spark, folder, "op13_token_alignment"), sorted(brute_alignment(rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: repr(r[:7])), sorted(want, key=lambda r: repr(r[:7]))):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])
    assert sum(w[1] == 0 for w in want) == 4 and any(w[0] == 52 and w[1] for w in want)


def test_units_are_coded_like_whole_texts():
    whole, pieces, _, _ = token_bytes()
    of = align.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    parts = ["word", "é", "漢字", " ", "  ", "\n", "\t", "\r\n", "\u3000", "\x85", "\x1c", "don't", "'s", "12", "3", "--", "!?", "👩‍👧", "\u0301", "\x00", "İ", "<s>", "<|endoftext|>", "ab" * 300]
    for _ in range(3000):
        text = " " + "".join(rng.choices(parts, k=rng.randint(1, 12)))
        units = align.UNITS.findall(text)
        assert "".join(units) == text and all(u[0] == " " for u in units)
        assert [x for u in units for x in of.encode_a(u)] == whole.encode(text, add_special_tokens=False).ids
        assert [x for ids in of.b.encode(units) for x in ids] == pieces.encode(text[1:])


def test_union_find_and_small_memories(spark, rows, folder, monkeypatch):
    rng = np.random.default_rng(3)
    for n in (1, 2, 50):
        u, v = rng.integers(0, n, 40), rng.integers(0, n, 40)
        up = align.union_find(n, u, v)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(u.tolist(), v.tolist()):
                want[x] = want[y] = min(want[x], want[y])
        assert up.tolist() == want
    of = align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t or "" for _, t in rows]
    all_at_once = of.documents(texts)
    monkeypatch.setattr(align, "MOST_UNITS", 3)
    for k, t in enumerate(texts):
        out, pairs, links = of.documents([t])
        assert out[0] == all_at_once[0][k]
    assert align.alignment(table(spark, []), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).isEmpty()
    assert periodic.periodic_runs(table(spark, [])).isEmpty()
