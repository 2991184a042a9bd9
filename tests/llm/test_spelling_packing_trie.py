"""Spelling variants, packing and the conversation trie against plain versions, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import bin_packing, conversation_trie, spelling_variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
LOW = str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)

# spelling variants


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_variants(counts, times=10):
    near = defaultdict(list)
    for a, b in itertools.combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and distance(a, b) == 1:
            near[a].append(b), near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def mutated(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind < 2) :]


def family(rng, letters, n, most=12):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, most))) for _ in range(n)}
    for _ in range(2):
        words |= {w for x in words for w in (mutated(rng, x, letters),) if len(w) >= 7}
    return sorted(words)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aéüzÿ÷"])
@pytest.mark.parametrize("part", [spelling_variants.PART, 3])
def test_variants_against_all_pairs(spark, letters, part):
    rng = random.Random(len(letters) + part)
    counts = {w: rng.choice([2, 3, 20, 30, 200, 200, 3000, 40000]) for w in family(rng, letters, 60)}
    counts |= {"aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 500, "a" * 300: 2, "a" * 301: 30}
    got = spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), part=part)
    assert {tuple(r) for r in got.collect()} == plain_variants(counts)


def test_long_chains_of_forms(spark):
    """Each word is the form of the one before: a root at the end of seven steps."""
    words = ["aaaaaaaa"[:i] + "bbbbbbbb"[i:] for i in range(8)]
    counts = {w: 2 * 10**i for i, w in enumerate(words)}
    got = {r.word: r.root for r in spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == dict.fromkeys(words, words[-1])


def test_leading_grams_survive_an_edit():
    """Of two near words some leading gram of the one is a leading gram of the other, at the same place or one further."""
    rng = random.Random(3)
    order = np.random.default_rng(3).permutation(spelling_variants.BUCKETS).astype(np.int32)
    for letters in ("ab", "abc", "abcdefghijkl"):
        for _ in range(3000):
            a = "".join(rng.choice(letters) for _ in range(rng.randint(7, 11)))
            b = mutated(rng, a, letters)
            if len(b) < 7 or a == b:
                continue
            short, long = sorted((a, b), key=len)
            other = set(spelling_variants.leading_grams(long, order, 3))
            shifts = (0,) if len(a) == len(b) else (0, 1)
            assert any((g, p + s) in other for g, p in spelling_variants.leading_grams(short, order, 3) for s in shifts), (a, b)


def test_merged_counts_lists():
    rng = random.Random(4)
    for _ in range(2000):
        lists = [sorted(rng.sample(range(12), rng.randint(1, 8))) for _ in range(rng.randint(1, 7))]
        need = rng.randint(1, 5)
        counts = Counter(x for one in lists for x in one)
        assert spelling_variants.merged(lists, need) == sorted(x for x, n in counts.items() if n >= need)


def test_words_of_odd_texts(spark):
    rng = random.Random(6)
    words = family(rng, "abcdé", 30)
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "1"]) for _ in range(200))) for i in range(40)]
    rows += [(None, " ".join(words)), (None, "Straße STRASSE straße Große×große"), (5, None), (5, ""), (6, "x" * 50000), (6, "x" * 50000), (7, "ÀÉÎ ÀÉÎÀÉÎÀ àéîàéîà"), (7, "ÀÉÎÀÉÎÀ àéîàéîà")]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, word int, n int")
    counts = plain_words(rows)
    assert {r.word: r.n for r in spelling_variants.counted_words(docs).collect()} == counts
    assert {tuple(r) for r in spelling_variants.variants(spelling_variants.counted_words(docs)).collect()} == plain_variants(counts)
    assert spelling_variants.variants(spelling_variants.counted_words(docs.limit(0))).count() == 0


# packing


def numbered_pieces(spark, lengths, parts=4):
    rows = [(i, n, i % parts, None) for i, n in enumerate(lengths)]
    seen = Counter()
    out = []
    for i, n, part, _ in rows:
        out.append((i, n, part, seen[n, part]))
        seen[n, part] += 1
    return spark.createDataFrame(out, "id long, length long, part int, nth long")


def assert_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
        assert sum(n for _, n in places) <= capacity
    return len(bins)


def test_fullest_against_all_combinations():
    rng = random.Random(8)
    for _ in range(300):
        counts = {rng.randint(1, 15): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        room = rng.randint(0, 40)
        got = bin_packing.fullest(room, sorted((n for n in counts if n <= room), reverse=True), counts)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)
        assert all(0 < k <= counts[n] for n, k in got.items())


def test_bins_are_what_one_bin_at_a_time_gives():
    """The same combination taken many times at once fills as many bins, each as full, as taking it bin by bin."""
    rng = random.Random(9)
    for _ in range(40):
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, 33), 8)}
        left, plain = dict(counts), []
        while any(left.values()):
            longest = max(n for n, c in left.items() if c)
            left[longest] -= 1
            chosen = bin_packing.fullest(32 - longest, [n for n in sorted(left, reverse=True) if left[n] and n <= 32 - longest], left)
            for n, k in chosen.items():
                left[n] -= k
            plain.append(longest + sum(n * k for n, k in chosen.items()))
        got = [sum(n * k for n, k in chosen.items()) for times, chosen in bin_packing.fill_bins(counts, 32) for _ in range(times)]
        assert len(got) == len(plain) and sum(got) == sum(plain) == sum(n * c for n, c in counts.items())


def test_pack_places_every_piece(spark):
    rng = random.Random(10)
    for lengths in ([rng.randint(1, 64) for _ in range(700)], [7] * 500, [64] * 5 + [1] * 3, [33] * 20, [1], []):
        out = bin_packing.pack(numbered_pieces(spark, lengths), 64).collect()
        assert sorted(r.id for r in out) == list(range(len(lengths)))
        n = assert_packed(out, 64)
        assert n >= -(-sum(lengths) // 64)
        plain: list[int] = []
        for length in sorted(lengths, reverse=True):  # best fit, the longest first
            fits = [i for i, used in enumerate(plain) if used + length <= 64]
            if fits:
                plain[max(fits, key=plain.__getitem__)] += length
            else:
                plain.append(length)
        assert n <= 1.01 * len(plain)
    with pytest.raises(ValueError):
        bin_packing.pack(numbered_pieces(spark, [65]), 64)
    with pytest.raises(ValueError):
        bin_packing.pack(numbered_pieces(spark, [0]), 64)


def test_bins_stay_few_for_any_number_of_pieces():
    """The plan's size depends on the capacity, not on the pieces."""
    rng = random.Random(12)
    small = {n: rng.randint(1, 40) for n in range(1, 100)}
    large = {n: c * 10**9 + rng.randint(0, 99) for n, c in small.items()}
    few, many = (bin_packing.fill_bins(h, 256) for h in (small, large))
    assert len(many) < 256 * 8 and sum(t for t, _ in many) < 1.0001 * sum(n * c for n, c in large.items()) / 256
    assert len(few) < 256 * 8


ODD = [None, "", " ", "a", "  two  blanks ", "tab\tand\nline \n x", "don't we'll", "x" * 9000, "é ü ß　x   y", "<|endoftext|> and <|endoftext|>x", "日本語 テキスト " * 300, "​ z\u0085 q \x1c r", "word " * 5000, "1 2  3   4    5"]


def test_words_give_the_ids_of_whole_texts():
    with open(bin_packing.tokenizer_file(), encoding="utf-8") as f:
        encoder = bin_packing.Encoder(f.read())
    rng = random.Random(13)
    signs = ["a", "B", "é", " ", " ", "  ", "\n", "\t", "'s", "'", "1", ".", " ", "　", "日", "\x1f", "<|endoftext|>", " "]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    whole = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for _ in range(2):
        assert [encoder.text(t) for t in texts] == whole


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 0)] * 400 + [(None, "no id", None, None, None)] * 2
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS length", "2 AS part", "3 AS _n", "4 AS offset")
    out = bin_packing.pack_documents(docs.repartition(5)).collect()
    assert_packed([r.asDict() for r in out], 2048)
    tokenizer = Tokenizer.from_file(bin_packing.tokenizer_file())
    wanted = Counter()
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for i, (lo, hi) in enumerate([(0, first), *((at, at + 2048) for at in range(first, len(ids), 2048))]):
            wanted[doc, i, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == wanted
    assert bin_packing.pack_documents(docs.limit(0)).count() == 0


# conversation trie


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        parents = {p[:-1] for p in below if p}
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(path))
        out.append((
            own[0], len(path), members[path[:-1]][0] if path else None, len(own), sum(p[:-1] == path for p in below if p), sum(p not in parents for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(out)


def conversations(seed, n, texts, most):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(4 * n), n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", "t" * rng.randint(1, texts)))
    return rows


@pytest.mark.parametrize(("seed", "texts", "most", "parts"), [(1, 2, 4, 1), (2, 2, 6, 4), (3, 1, 9, 7), (4, 3, 3, 16), (5, 9, 2, 3)])
def test_trie_against_all_prefixes(spark, seed, texts, most, parts):
    rows = conversations(seed, 150, texts, most)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, TURNS)
        got = conversation_trie.conversation_trie(conversation_trie.rebuilt(conversation_trie.turn_arrays(df))).collect()
        assert Counter(tuple(r) for r in got) == plain_trie(plain_rebuilt(rows))
        if parts > 1:
            swept = conversation_trie.swept(conversation_trie.turn_arrays(df)).where("kind = 3").count()
            assert swept > 1  # there are borders to stitch
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "b"), (1, 1, "user", "a"), (2, 1, "user", "a"), (2, 1, "user", "a"), (None, 1, "user", "a"), (100, 0, "u", "x"), (101, 5, "u", "x")]
    rows += [(c, 0, "u", "same") for c in range(200, 260)] + [(300, t, "u", "long") for t in range(500)] + [(7, 0, "1:u", "x"), (8, 0, "1:", "ux"), (9, 0, "", ""), (107, 1, "u", "y")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS + ", key int, turns int")
    got = conversation_trie.conversation_trie(conversation_trie.rebuilt(conversation_trie.turn_arrays(df))).collect()
    convs = plain_rebuilt(rows)
    assert not convs[107] or len(convs[107]) == 1
    assert Counter(tuple(r) for r in got) == plain_trie(convs)
    assert conversation_trie.conversation_trie(conversation_trie.rebuilt(conversation_trie.turn_arrays(df.limit(0)))).count() == 0
    turnless = spark.createDataFrame([(c, 0, "u", "x") for c in range(1001, 1012)], TURNS)
    got = conversation_trie.conversation_trie(conversation_trie.rebuilt(conversation_trie.turn_arrays(turnless))).collect()
    assert Counter(tuple(r) for r in got) == plain_trie(plain_rebuilt([(c, 0, "u", "x") for c in range(1001, 1012)]))


def test_sweeps_stitch_at_any_border():
    """Plain: two neighbouring stretches and the correction between them give the sums of one sweep over both."""
    rng = random.Random(21)
    turn = lambda x: hashlib.sha256(str(x).encode()).hexdigest()[: conversation_trie.TURN]
    rows = []
    for c in range(60):
        turns = [rng.randint(0, 1) for _ in range(rng.randint(0, 5))]
        rows.append((c, "".join(map(turn, turns)), [x + 3 for x in turns]))
    rows.sort(key=lambda r: (r[1], r[0]))

    def sums(swept):
        out = defaultdict(lambda: [0, 0, 0, 0])
        for kind, _, key, *_, n, children, leaves, saved, _, _ in swept:
            if kind in (conversation_trie.NODE, conversation_trie.OPEN):
                out[key] = [a + b for a, b in zip(out[key], (n, children, leaves, saved))]
        return dict(out)

    whole = sums(conversation_trie.sweep(iter(rows), 0))
    for cut in range(1, len(rows)):
        one, two = list(conversation_trie.sweep(iter(rows[:cut]), 0)), list(conversation_trie.sweep(iter(rows[cut:]), 1))
        between = list(conversation_trie.border(rows[cut - 1][1], rows[cut][1], rows[cut - 1][2]))
        assert sums(one + two + between) == whole
