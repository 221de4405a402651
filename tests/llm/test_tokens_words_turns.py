"""Token files, spelling variants and conversation repair against brute force, round trips and SQL."""

import io
import itertools
import random
import re
import string
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import byte_tokens, conversation_repair, queries, spelling_variants, token_files, turn_alignment
from corpusmill.llm.seekable import Reader, Writer

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


# --- token files --------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(byte_tokens.default_tokenizer())


ODD_TEXT = st.text(st.one_of(st.sampled_from(" \n\t\r  　\x1c\x85.,!?'sa1Zé<|"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD_TEXT, max_size=4))
def test_runs_are_tokenised_as_whole_texts(texts):
    whole = Tokenizer.from_file(byte_tokens.default_tokenizer()) if not hasattr(test_runs_are_tokenised_as_whole_texts, "t") else test_runs_are_tokenised_as_whole_texts.t
    test_runs_are_tokenised_as_whole_texts.t = whole
    got = list(byte_tokens.byte_spelled(byte_tokens.default_tokenizer()).texts(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_runs_with_a_space_are_tokenised_together(tokenizer):
    texts = [" ".join(f"{'añ' * (i % 7)}x{i}" for i in range(k, 3000, 3)) + " 's  \n\x1c z's" for k in range(3)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    spelled, calls = byte_tokens.ByteSpelled(byte_tokens.default_tokenizer()), []

    class Counted:
        def encode_batch_fast(self, runs, **options):
            calls.append(len(runs))
            return tokenizer.encode_batch_fast(runs, **options)

    spelled.tokenizer = Counted()
    assert [np.frombuffer(t, "<u4").tolist() for t in spelled.texts(texts)] == want and sum(calls) < 30
    spelled.known.clear()
    spelled.widths[:] = 1  # tokens that seem to reach across: run by run
    assert [np.frombuffer(t, "<u4").tolist() for t in spelled.texts(texts)] == want and sum(calls) > 3000


def test_distinct_runs_of_texts_are_looked_up_once(tokenizer):
    asked = Counter()

    class Asked(dict):
        def get(self, key, default=None):
            asked[key] += 1
            return super().get(key, default)

        def __getitem__(self, key):
            asked[key] += 1
            return super().__getitem__(key)

    texts = ["Une ville,\nthe house. " * 500 + "end", "\nthe ville,\n", "", None] * 5
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    spelled = byte_tokens.ByteSpelled(byte_tokens.default_tokenizer())
    spelled.known = Asked()
    for given in (texts, pa.array(texts)):
        assert [np.frombuffer(t, "<u4").tolist() for t in spelled.texts(given)] == want
    assert len(asked) < 30 and max(asked.values()) < 10


def test_short_texts_of_all_kinds_of_white_space(tokenizer):
    texts = ["".join(t) for n in range(7) for t in itertools.product(" \n\ta,", repeat=n)]
    texts += ["".join(t) for t in itertools.product("\n \r\xa0\u2009é9", repeat=5)]
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    got = byte_tokens.ByteSpelled(byte_tokens.default_tokenizer()).texts(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_parts_hold_whole_batches_or_rows(monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_CHARS", 100)
    texts = ["a" * n for n in (1, 2, 0, 300, 5, 5)] + [None] * 20
    rows = pa.table({"_id": range(len(texts)), "_text": pa.array(texts)})
    for size in (1, 4, 100):
        parts = list(token_files._in_parts(iter(rows.to_batches(size))))
        assert pa.concat_tables(parts).equals(rows)
        assert [len(p) for p in parts] == [4, 6, 7, 7, 2]
    assert list(token_files._in_parts(iter([]))) == []


def _read(data, reads=None):
    return Reader(lambda at, n: (reads.append((at, n)) if reads is not None else None, data[at:at + n])[1], len(data))


def test_frames_are_read_alone_and_checked():
    out, docs = io.BytesIO(), [(i if i != 3 else None, np.arange(i * 10, dtype="<u4").tobytes()) for i in range(60)]
    writer = Writer(out, 2, 1000)
    for d in docs:
        writer.add(*d)
    writer.close()
    data, reads = out.getvalue(), []
    reader = _read(data, reads)
    assert len(reader.seek) > 10 and writer.bytes == len(data) and writer.docs == 60
    assert [(d.doc_id, d.tokens) for d in reader.documents()] == docs
    few = _read(data, reads)
    assert [d.doc_id for d in few.documents({7, 55, 900})] == [7, 55] and few.frames_read == 2
    assert [d.start for d in few.documents({55})] == [sum(10 * i for i in range(55))]
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)  # any reader takes the file
    assert len(plain) == int(reader.seek["plain"].sum())
    broken = bytearray(data)
    broken[int(reader.offsets[4]) + 12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(_read(bytes(broken)).documents())
    with pytest.raises(ValueError):
        _read(data[:-1])


@pytest.mark.parametrize("parts, frame_bytes", [(1, 1 << 20), (6, 300)])
def test_token_files(spark, tokenizer, parts, frame_bytes):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice(string.ascii_letters + "éß,. ") for _ in range(r.randint(1, 9))) for _ in range(n))
    rows = [(i * 7 % 90 - 5, text(r.randint(0, 60))) for i in range(90)] + [(4, None), (200, ""), (201, "w " * 60_000), (None, "no id"), (202, "x<|endoftext|>y"), (2**60 + 1, "far")]
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], DOCS + ", path string, tokens long").repartition(parts)
    folder = token_files.token_folder(spark)
    files = token_files.write_token_files(docs, folder, frame_bytes=frame_bytes)
    got = token_files.read_token_files(files, folder, with_tokens=True).collect()
    assert len(got) == len(rows)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert Counter((x.doc_id, bytes(x.tokens)) for x in got) == Counter((i, np.array(ids(t), "<u4").tobytes()) for i, t in rows)
    start = 0
    for x in sorted(got, key=lambda x: x.start):
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(x.tokens) // 4, zlib.crc32(x.tokens))
        start += x.n_tokens
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start)]
    assert order == sorted(order, key=lambda i: -(2**63) if i is None else i)
    few = token_files.read_token_files(files, folder, {201, 10}).collect()
    assert {(x.doc_id, x.start) for x in few} == {(x.doc_id, x.start) for x in got if x.doc_id in (201, 10)}


def test_token_files_of_nothing(spark):
    folder = token_files.token_folder(spark)
    files = token_files.write_token_files(spark.createDataFrame([], DOCS), folder)
    assert files.count() == 0 and token_files.read_token_files(files, folder).count() == 0


# --- spelling variants --------------------------------------------------------
def brute_words(rows):
    counts, lower = Counter(), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and (a[p + 1:] == b[p + 1:] if len(a) == len(b) else len(a) == len(b) + 1 and a[p + 1:] == b[p:])


def brute_groups(counts):
    near = {w: [u for u in counts if one_edit(w, u)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(((-counts[u], u) for u in found), default=(0, None))
        form[w] = best[1] if best[1] and -best[0] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_spelling_variants(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abéÿ") for _ in range(r.randint(5, 9))) for _ in range(60)] + ["q" * 6, "q" * 7, "q" * 8, "Q" * 9, "z" * 300, "z" * 299, "z" * 150 + "y" + "z" * 149]
    base += ["".join(r.choice("xy") for _ in range(130)) for _ in range(2)]
    base += [base[-1][:100] + "x" + base[-1][101:], base[-1][:20] + "zz"[:1] + base[-1][20:], base[-2][:64] + base[-2][65:]]
    rows = [(i, r.choice([" ", "\n", "1", "."]).join(r.choices(base, [1 + k % 7 * 6 for k in range(len(base))], k=r.randint(0, 120)))) for i in range(60)]
    rows += [(None, "abcdef " * 40), (7, None), (8, ""), (8, "×÷×÷×÷ " * 30), (9, "abcdeg " * 6), (10, "abcdefh " * 250)]
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], DOCS + ", word string, n long").repartition(3)
    counts = brute_words(rows)
    got = spelling_variants.group_words(spelling_variants.frequent_words(spelling_variants.damaged_words(docs)))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {x.word: tuple(x)[1:] for x in got.collect()} == brute_groups(counts)


def test_chains_of_forms_lead_to_one_root(spark):
    words = [("abcdef", 1), ("abcdefg", 5), ("abcdefgh", 25), ("abcdefghi", 125), ("abcdefghij", 124 * 5), ("zzzzzz", 3)]
    got = {x.word: x.root for x in spelling_variants.group_words(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"abcdef": "abcdefghi", "abcdefg": "abcdefghi", "abcdefgh": "abcdefghi", "abcdefghi": "abcdefghi", "abcdefghij": "abcdefghij", "zzzzzz": "zzzzzz"}


def test_no_words(spark):
    empty = spelling_variants.damaged_words(spark.createDataFrame([(1, None), (2, "12 .")], DOCS))
    assert spelling_variants.group_words(spelling_variants.frequent_words(empty)).count() == 0


# --- conversation repair ------------------------------------------------------
def brute_align(codes):
    @lru_cache(None)
    def go(i, state, inserted):
        expected, then = ("a", "U") if state == "A" else ("u", "A")
        ways = [(0, "")] if i == len(codes) and state in "BU" else []
        if i < len(codes):
            code = codes[i]
            ways.append((3, "D", i + 1, state, 0))
            if not code.isdigit():
                cut = int(code.isupper())
                if state == "B" and code in "sS":
                    ways.append((cut, "K", i + 1, "P", 0))
                same = code.lower() == expected
                ways.append((cut + 2 * (not same), "K" if same else "R", i + 1, then, 0))
        if inserted < 3:
            ways.append((2, "I", i, then, inserted + 1))
        ended = [(w[0] + c, w[1] + a) for w in ways if len(w) > 2 for c, a in [go(*w[2:])]] + [w for w in ways if len(w) == 2]
        return min(ended, default=(10**9, ""))

    return go(0, "B", 0)


@pytest.mark.parametrize("block", [1, 3, 32])
def test_alignment(block):
    r = random.Random(block)
    for k in range(700):
        letters = r.choice([["u", "a", "s", "o"], list("suaoSUAO0123"), ["ua", "ua", "uA", "u", "a", "1a", "u2"], ["s", "S", "0", "u"]])
        codes = "".join(r.choice(letters) for _ in range(r.randint(0, 22)))
        assert turn_alignment.align(codes, block) == brute_align(codes), codes


def test_long_conversations_take_time_in_proportion():
    cost, audit = turn_alignment.align("sua" + "uAua" * 2_000)
    assert (cost, len(audit)) == (2_000, 8_003) and set(audit) == {"K"}


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(queries.OP13)
    names = [d[0] for d in cursor.description]
    return {x["conv_id"]: x for x in (dict(zip(names, row)) for row in cursor.fetchall())}


def test_conversations_with_odd_rows(spark):
    r = random.Random(6)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Why?", None, "x" * 30_000 + ".", "a\nb.", "a ."]
    rows = [(c, r.choice([t, t, t, None]), r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"]), r.choice(texts))
            for c in [*range(40), None] for t in range(r.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}" + "." * (t % 9 > 0)) for t in range(700)]  # one long conversation
    rows += [rows[0], rows[0], rows[5]]
    table = spark.createDataFrame([(*x, "a", 1) for x in rows], TURNS + ", audit string, place long").repartition(5)
    got = {x.conv_id: x.asDict() for x in conversation_repair.damaged_and_repaired(table).collect()}
    assert got == sql_rows(rows)


def test_one_conversation_over_many_partitions(spark):
    """Order, faults and audit do not depend on where the range exchange cuts."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"Text {t % 5}.") for t in range(500)]
    table = spark.createDataFrame(rows, TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for parts in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append(conversation_repair.damaged_and_repaired(table).collect())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) == 1 and seen[0][0].asDict() == sql_rows(rows)[1]


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Hello."), (1, 3, "tool", "Hi!"), (1, 4, "user", "Bye."), (2, 0, "user", " ")]
    conversations, repaired = conversation_repair.repair(spark.createDataFrame(rows, TURNS))
    assert {x.conv_key: x.audit for x in conversations.collect()} == {"c1": "KKDRKI", "c2": "D"}
    assert [(x.edit, x.role, x.text) for x in repaired.orderBy("place").collect()] == [
        ("K", "system", "Be kind."), ("K", "user", "Hello."), ("R", "assistant", "Hi!"), ("K", "user", "Bye."), ("I", "assistant", "")]


def test_empty_conversations(spark):
    table = spark.createDataFrame([], TURNS)
    assert conversation_repair.damaged_and_repaired(table).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversation_repair.damaged_and_repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.")], TURNS)).collect()
    assert [tuple(x) for x in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", sql_rows([(dropped, 0, "user", "Hi.")])[dropped]["repaired_sha256"])]
