"""The pipeline operators against brute force, round trips and held-out labels, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusmill.llm import avi, jpeg, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, toxicity
from corpusmill.llm.tokens import default_tokenizer, spelled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    word = lambda v: str(r.randrange(v))
    pool = [" ".join(word(40) for _ in range(r.randint(30, 90))) for _ in range(6)]
    out = []
    for i in range(40):
        parts = [r.choice(pool) if r.random() < 0.5 else " ".join(word(500) for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 4))]
        out.append((i, r.choice(["\n", " ", "\t \n"]).join(parts), "en", r.choice(["a", "b", None]), 1))
    copy = out[7][1]
    near = copy.split()
    return [*out, (40, None, None, None, None), (41, "", "en", "a", 0), (42, copy, "en", "a", 1), (43, " ".join([*near[:-1], "z"]), "en", "b", 1),
            (44, "x " * 300, "en", "b", 1), (45, "Ünï\u0000 ÀB\n" * 30, "de", "b", 1), (46, "w " * 30_000, "en", "a", 1), (47, "a b", "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, and columns with names that operators use inside."""
    text = "one two three four five six seven eight nine ten eleven " * 8
    return spark.createDataFrame(
        [(None, text, "a", 1, "k"), (1, text, None, 2, "k"), (1, text, None, 2, "k"), (2, None, "a", None, None)], "doc_id long, text string, source string, id long, key string")


def words(text):
    return (text or "").encode().split()


def collected(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_quality_rules(docs, rows):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        w, text = words(text), text or ""
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + o for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for o in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        expected = (len(w), sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][1:6]) == expected, i
        assert got[i].base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))


def letters(n):
    return "".join(chr(97 + int(x)) for x in str(n))


def test_common_lines_deplete(spark):
    own = lambda i: " ".join(f"{letters(i)}x{letters(k)}" for k in range(60 if i % 2 == 0 else 8))
    data = [(i, "the same line of this host once more, and again it is here as ever before\n" + own(i), "h") for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[0].chars_dropped == 0 and got[1].chars_dropped == 73
    assert not got[1].kept and got[2].kept
    good = {r.doc_id: r.text for r in quality_rules.keep_good(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert good == {0: data[0][1]} | {i: own(i) for i in range(2, 60, 2)}


def test_line_limit_falls_as_the_host_grows(spark):
    line = "this line of the host is in its twenty-five first texts, wherever they are"
    for n, gone in ((500, True), (700, False)):  # 25 is the root of 625
        data = [(i, (line + "\n" if i < 25 else "") + " ".join(f"{letters(i)}x{letters(k)}" for k in range(60)), "h") for i in range(n)]
        got = quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string"))
        assert got.where("chars_dropped > 0").count() == (24 if gone else 0)


def test_texts_of_one_id_lose_their_own_lines(spark):
    line, own = "a common line that all pages of this host begin with, again and again", lambda i: " ".join(f"{i}x{letters(k)}" for k in range(60))
    data = [(i, f"{line}\n{own(letters(i))}", "h") for i in range(30)] + [(29, own("x"), "h"), (29, f"{line}\nfew words that are left of this text", "h")] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = [(r.chars_dropped, r.kept) for r in quality_rules.quality_rules(docs).where("doc_id = 29").collect()]
    assert Counter(got) == {(len(line), True): 1, (0, True): 2, (len(line), False): 2}
    assert Counter(r.text for r in quality_rules.keep_good(docs).where("doc_id = 29").collect()) == {own(letters(29)): 1, own("x"): 2}


def test_line_dedup(docs, rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_substring_dedup(docs, rows):
    seen = Counter(tuple(w[p : p + 35]) for w in (words(t) for _, t, *_ in rows) for p in range(len(w) - 34))
    got = collected(substring_dedup.substring_dedup(docs))
    for i, text, *_ in rows:
        w = words(text)
        gone = {p + o for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for o in range(35)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()), i


@pytest.mark.parametrize("small_blocks", [False, True])
def test_suffix_dedup(docs, rows, small_blocks, monkeypatch):
    if small_blocks:  # a key with more segments than a block holds
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 400)
        monkeypatch.setattr(suffix_dedup, "BLOCK_SEGMENTS", 4)
    got, seen = collected(suffix_dedup.suffix_dedup(docs)), set()
    for i, text, *_ in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        assert got[i][:4] == (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()), i


@pytest.mark.parametrize("batch, parts", [(10_000, 1), (10_000, 5), (2, 1), (3, 5)])
def test_suffix_dedup_keeps_repeated_rows(spark, batch, parts):
    """Rows of one id are one document: only what starts earlier goes."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    one, two, mid = text(900), text(700), text(130)
    data = {3: one, 5: two + mid, 6: text(90) + one[100:600] + mid + text(150), 7: one, 9: text(200) + mid + mid}
    table = [(i, x) for i, x in data.items() for _ in range(1 if i == 5 else 3)]
    r.shuffle(table)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = suffix_dedup.suffix_dedup(docs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    seen, left = set(), {}
    for i, x in data.items():
        gone = set()
        for p in range(len(x) - 99):
            gone |= set(range(p, p + 100)) if x[p : p + 100] in seen else set()
            seen.add(x[p : p + 100])
        left[i] = (len(gone), hashlib.sha256("".join(c for p, c in enumerate(x) if p not in gone).encode()).hexdigest())
    assert left[3][0] == left[5][0] == 0 and left[7][0] == 900 and len(got) == len(table)
    for g in got:
        assert (g.n_removed, g.kept_sha256) == left[g.doc_id], g.doc_id


def test_contexts_have_64_bits():
    """100,000 surroundings of one anchor: 30 or 31 bits would tell some of them apart no more."""
    r = np.random.default_rng(1)
    sums = [np.concatenate([np.zeros(1, np.uint64), r.integers(0, 1 << 63, 300_000).astype(np.uint64)]) for _ in range(2)]
    _, context, _, _ = substring_dedup.anchors([np.cumsum(s) for s in sums], 35)
    _, second = substring_dedup.passage_hashes(sums, np.arange(100_000), np.arange(100_000) + 35)
    _, own, _, _ = suffix_dedup.segments(r.integers(0, 256, 6_000_000).astype(np.uint8), 100)
    for found in (context, second, own):
        upper = (found >> 32).astype(np.int32)
        assert found.dtype == np.int64 and found.all() and len(found) > 60_000 and len(np.unique(found)) == len(found)
        assert len(np.unique(upper)) > 0.999 * len(upper)


def test_near_duplicates(docs, rows):
    sets = {}
    for i, text, *_ in rows:
        w = [x.lower() for x in words(text)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and top(a) != top(b):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    got = collected(minhash.near_duplicates(docs))
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_labels_never_leave_the_training_folds_and_score_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    quality = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    true = {r.doc_id: r for r in labels.collect()}
    got = {r.doc_id: r for r in quality.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(true[i].quality, r.predicted) for i, r in got.items() if r.held_out and i in true]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    toxic = {r.doc_id: r for r in toxicity.score(docs, *toxicity.train(docs, labels)).collect()}
    assert len(toxic) == len(got) and all(0 <= r.score <= 1 for r in toxic.values())


def test_toxicity_learns_stems_not_copied_words(spark):
    r = random.Random(1)
    plain = lambda: " ".join("w%d" % r.randrange(300) for _ in range(40))
    data = [(i, plain() + (" you are vileman%d ." % (i % 7) if i % 4 == 0 else " ."), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, toxic int")
    got = collected(toxicity.score(docs, *toxicity.train(docs, labels)))
    assert all(got[i][2] == y for i, _, y in data)


def test_grammar_is_ordered():
    """Negation and report weaken what follows them within reach, a target strengthens."""
    lexicon = toxicity.Lexicon({"scum": 3.0, "you": 1.0, "burn": 2.0})
    weigh = lambda text: sum(lexicon.clauses(text)[0])
    plain = weigh("they are scum.")
    assert plain > weigh("he said they are scum.") > weigh("they are not scum.") > weigh("he said they are not scum.") > 0
    assert weigh("they are scum, not nice.") == plain == weigh("not a nice day, they are scum.") == weigh("he is not here\nthey are scum")
    assert weigh("not one two three four scum") == weigh("scum") < weigh("scum like them") == plain
    assert weigh("said this, scum.") == weigh("said scum.") < weigh("said this. scum.")
    assert weigh("you") == 1.5 and weigh("burn") == 2.0  # all readings: an insult that is a target or a threat
    assert lexicon.clauses("kill them. nothing. scum\nscum")[0] == [1.5, 3.0, 3.0] and lexicon.clauses("")[0] == []


def _toxic_sample(spark, n=400):
    r = random.Random(1)
    plain = lambda: " ".join("w%d" % r.randrange(300) for _ in range(40))
    data = [(i, plain() + (" . you are vileman%d ." if i % 4 == 0 else " . you are w%d .") % (i % 7), int(i % 4 == 0)) for i in range(n)]
    return (spark.createDataFrame([d[:2] for d in data], "doc_id long, text string"), spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, toxic int"))


def test_direct_reported_and_denied_insults_get_falling_scores(spark):
    model = toxicity.train(*_toxic_sample(spark))
    body = "w1 w2 w3 w4 w5 w6 w7 w8 . {} ."
    texts = ["you are vileman1", "he said you are vileman1", "you are not vileman1", "nothing at all"]
    got = collected(toxicity.score(spark.createDataFrame([(i, body.format(t)) for i, t in enumerate(texts)], "doc_id long, text string"), *model))
    scores = [got[i][1] for i in range(4)]
    assert scores[0] > scores[1] > scores[2] > scores[3] and got[0][2] == 1 and got[3][2] == 0
    without = toxicity.score(spark.createDataFrame([(0, body.format(texts[0]))], "doc_id long, text string"), {}, model[1]).first()
    assert without.score == got[3][1]  # nothing outside matched clauses counts


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1), (3, 1)], [(1, None)]])
def test_training_without_both_labels_scores_a_half(spark, labels):
    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    for docs in (rows, rows.limit(0)):
        marks = spark.createDataFrame(labels, "doc_id long, toxic int")
        got = toxicity.score(rows, *toxicity.train(docs, marks)).collect()
        assert [x.score for x in got] == [0.5] * 3
        both = quality_classifier.train(docs, marks.withColumnRenamed("toxic", "quality"))
        assert quality_classifier.score(rows, both).count() == 3


def test_toxic_documents_are_found_among_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    true = {r.doc_id: r.toxic for r in labels.collect()}
    found = [(true[r.doc_id], r.predicted) for r in toxicity.score(docs, *toxicity.train(docs, labels)).collect() if r.held_out and r.doc_id in true]
    toxic, clean = [p for y, p in found if y == 1], [p for y, p in found if y == 0]
    assert len(toxic) > 20 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_avi_round_trip(docs, rows):
    got = {r.doc_id: r for r in avi.media_columns(docs, with_media=True).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        assert r.clips[0].first == 0 and all(a.last + 1 == b.first for a, b in zip(r.clips, r.clips[1:]))
    assert got[7].feature == got[42].feature and got[7].media_sha256 == got[42].media_sha256


def test_shots_follow_histograms():
    dark, light = np.zeros(32, int), np.zeros(32, int)
    dark[1], light[20] = 64, 64
    assert avi.shots(np.array([dark] * 4 + [light] * 3 + [dark] * 2)) == [(0, 3), (4, 6), (7, 8)]


def test_jpeg_decoder_reads_runs_and_end_of_block():
    """A frame of one grey block, one DC and one AC coefficient after a run of two zeros."""
    dc, ac = bytes([0, 1] + [0] * 14 + [3]), bytes([0, 2] + [0] * 14 + [0x00, 0x22])
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + bytes([2] * 64)) + jpeg._segment(0xC0, b"\x08\0\x08\0\x08\x01\x01\x11\0")
    head += jpeg._segment(0xC4, b"\0" + dc) + jpeg._segment(0xC4, b"\x10" + ac) + jpeg._segment(0xDA, b"\x01\x01\0\0\x3f\0")
    bits = "00" + "101" + "01" + "00" + "00"  # DC 5; run 2, size 2, value -3; end
    body = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    (_, _, c, q), = jpeg.decode_frames([head + body + b"\xff\xd9"])
    assert c[0, 0, 0] == 5 and c[0, 0, 3] == -3 and np.count_nonzero(c) == 2 and q[0] == bytes([2] * 64)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    pieces, sequences = {}, {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_fill_is_the_best_subset_sum():
    r = random.Random(3)
    for _ in range(200):
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, 40), 5)}
        capacity = r.randint(1, 120)
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c + 1)}
        chosen = packing.fill(counts, capacity)
        assert all(c <= counts[n] for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= capacity)


def test_cached_words_spell_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, r = Tokenizer.from_file(default_tokenizer()), random.Random(4)
    signs = "aB é'sD.1２ſß́  \x1c\x85İΣσς<|endoftext|>'re \t\n\x0b\x0c\r漢字🙂!!,;.:?"
    texts = ["".join(r.choice(signs) for _ in range(25)) + r.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "Ab,", "it's."]) for _ in range(500)]
    for text, ids in zip(texts, spelled(default_tokenizer()).texts(texts)):
        assert tokenizer.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_apportion_is_highest_quotients(spark):
    r, data, expected = random.Random(2), [], {}
    for g in range(6):
        weights, seats = [r.choice([0, 1, 5, 40, 1000]) * r.random() for _ in range(r.randint(1, 9))], r.randint(0, 60)
        quota = [0] * len(weights)
        for _ in range(seats if any(weights) else 0):
            best = max(range(len(weights)), key=lambda k: (weights[k] / (2 * quota[k] + 1), -k))
            quota[best] += 1
        data += [(g, k, float(w), seats) for k, w in enumerate(weights)]
        expected |= {(g, k): q for k, q in enumerate(quota) if weights[k]}
    got = mixing.apportion(spark.createDataFrame(data, "g int, k int, w double, n int"), "g", "k", "w", "n")
    assert {(x.g, x.k): x.quota for x in got.collect()} == expected


def test_mix(docs, rows):
    got = {r.doc_id: r for r in mixing.mix(docs, block=4, shard_words=500).collect()}
    sizes = {i: len(words(t)) for i, t, *_ in rows}
    sources = sorted({s for *_, s, _ in rows}, key=lambda s: (s is None, s))
    total = {s: sum(sizes[i] for i, _, _, x, _ in rows if x == s) for s in sources}
    weight = dict(zip(sources, (5, 2, 1)))
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    for i, _, _, s, _ in rows:
        assert got[i].size == sizes[i] and got[i].source_size == total[s] and got[i].target == pytest.approx(target[s])
        assert 0 <= got[i].taken <= 3 * sizes[i]
    for s in sources:
        taken = sum(got[i].taken for i, _, _, x, _ in rows if x == s)
        assert abs(taken - target[s]) <= 4 * (total[s] / 500 + 3)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7), block=4, shard_words=500).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mixed_texts_have_the_taken_words(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = Counter()
    for r in mixing.mixed(docs).collect():
        got[r.doc_id] += len(words(r.text))
    assert got == {i: n for i, n in taken.items() if n}


def test_mixed_texts_are_copies_and_the_words_of_the_chosen_blocks(docs, rows):
    settings, texts = {"block": 4, "shard_words": 500}, {i: t or "" for i, t, *_ in rows}
    got = {}
    for r in mixing.mixed(docs, **settings).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    cut = 0
    for r in mixing.dealt_ranges(docs, **settings).where("taken > 0").collect():
        own, text = words(texts[r.doc_id]), texts[r.doc_id]
        copies, more = divmod(r.taken, r.size)
        picked = [w for a in r.ranges for w in own[a.low : a.high]] if more else []
        assert len(picked) == more and all(a.high < b.low for a, b in zip(r.ranges, r.ranges[1:]))
        parts = [t for t in got[r.doc_id] if t != text]
        assert len(got[r.doc_id]) == copies + bool(more) and len(parts) <= 1, r.doc_id  # a row per copy
        assert not more or words(parts[0]) == picked
        for a in r.ranges if more else []:  # white space inside a range is the text's
            at = [m.span() for m in re.finditer(rb"[^ \t-\r]+", text.encode())]
            assert text.encode()[at[a.low][0] : at[a.high - 1][1]] in parts[0].encode()
        cut += bool(more)
    assert cut > 2


def test_mixture_takes_whole_documents(spark):
    """Of each shard at most two documents are cut, whatever the share taken."""
    data = [(i, " ".join(f"{i}w{k}" for k in range(40 + i % 60)), "abc"[i % 3]) for i in range(1500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    texts = {i: t for i, t, _ in data}
    got = mixing.mixed(docs, shard_words=10_000).collect()
    shards = 3 * (500 * 100 // 10_000 + 1)
    assert len(got) > 1200 and sum(r.text != texts[r.doc_id] for r in got) <= 2 * shards
    assert {n for n in Counter(r.doc_id for r in got if r.source == "a").values()} <= {1, 2, 3}


def test_rows_without_id_spread_over_shards(spark):
    data = [(None, " ".join(f"{i}w{k}" for k in range(50)), "a") for i in range(400)]
    taken = [r.taken for r in mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), shard_words=1000).collect()]
    assert len(taken) == 400 and abs(sum(taken) - 20_000) <= 20 * 32


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    own = lambda i, n=50: " ".join(f"{i}w{k}" for k in range(n))
    table = [(None, own("a"), "s"), (None, own("b"), None), (None, "too short", "s"), (1, own("c"), "s"), (1, "again " * 40, "s"), (1, own("d", 200), None), (2, own("e"), None), (2, own("e"), None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3)
    good = quality_rules.keep_good(docs)
    expected = [r for r in table if r[1] != "too short" and not r[1].startswith("again")]
    assert Counter(map(tuple, good.collect())) == Counter(expected)
    got = Counter(tuple(r) for r in mixing.mixed(good, block=8, weights=(1, 1)).collect())
    assert sum(len(words(t)) * n for (_, t, _), n in got.items()) == sum(r.taken for r in mixing.mix(good, block=8, weights=(1, 1)).collect())
    assert {g[2] for g in got if g[0] is None} == {"s", None}
    for i, text, source in got:  # every text is made of words of its own row
        assert any((i, source) == (j, s) and set(words(text)) <= set(words(x)) for j, x, s in expected)
    again = Counter(tuple(r) for r in mixing.mixed(good.repartition(5), block=8, weights=(1, 1)).collect())
    assert again == got


OPERATORS = {
    "rules": quality_rules.quality_rules, "lines": line_dedup.line_dedup, "substring": substring_dedup.substring_dedup, "suffix": suffix_dedup.suffix_dedup,
    "minhash": minhash.near_duplicates, "avi": avi.media_columns, "packing": packing.pack, "mixing": mixing.mix,
    "toxicity": lambda d: toxicity.score(d, {"scum": 1.0}, np.zeros(toxicity.N_FEATURES)),
    "quality": lambda d: quality_classifier.score(d, np.zeros((1 << quality_classifier.BITS) + 16, np.float32))}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(odd, name):
    got = [r.asDict() for r in OPERATORS[name](odd).collect()]
    assert Counter({r["doc_id"] for r in got}) == Counter([None, 1, 2]) and (name == "packing" or len(got) == 4)
    same = [r for r in got if r["doc_id"] == 1]
    assert name in ("packing", "mixing") or same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.where("doc_id > 100")).count() == 0


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = docs.columns
    good = corpus_pipeline.quality(spark, docs, SF)
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert good.columns == names and {r.doc_id for r in good.collect()} == kept
    lined = corpus_pipeline.lines(spark, good, SF)
    assert lined.columns == names and lined.count() == len(kept)
    single = corpus_pipeline.near_copies(spark, docs, SF)
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert corpus_pipeline.mixture(spark, docs, SF).columns == names
    assert pq.read_table(f"{SF}/documents.parquet").num_rows >= corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() > 0
