"""Packing, SentencePiece codec, chat formatting and fingerprints."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jetframe.llm import chat, fingerprint, packing, pieces_codec


def table(spark, rows):
    kind = "doc_id bigint, text string, length int, rank int, lane int, bin int, anchors int"
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], kind).repartition(3)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_plan_is_best_fit_decreasing(histogram):
    sequences = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, slots, sequence, each, base in packing.plan_slots(histogram, 50):
        for k in range(slots):
            ranks[length].append(first + k)
            sequences[sequence + k // each].append((base + (k % each) * length, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {
        n: list(range(c)) for n, c in histogram.items()
    }
    for placed in sequences.values():
        end = 0
        for base, length in sorted(placed):
            assert base == end
            end += length
        assert end <= 50
    free = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [f for f in free if f >= length]
            if fits:
                free.remove(min(fits))
            free.append((min(fits) if fits else 50) - length)
    assert len(sequences) == len(free)


def test_pack(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [(n, "word " * (n % 40)) for n in range(60)]
    rows += [(70, None), (71, ""), (72, "<|endoftext|> é 中 \u00a0\n\n x"), (73, "long text, " * 500)]
    rows += [(None, "no id"), (5, "again"), (5, "again")]
    got = packing.pack(table(spark, rows), capacity=64).collect()
    wanted = Counter()
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        lengths = packing.piece_lengths(len(ids), 64)
        assert sum(lengths) == len(ids) and set(lengths[1:]) <= {64}
        for piece, length in enumerate(lengths):
            wanted[doc_id, piece, start, length, zlib.crc32(ids[start : start + length])] += 1
            start += length
    assert Counter(tuple(r)[:5] for r in got) == wanted
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in places.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("space", [" ", "\n"])
def test_pack_million_spaces(spark, space):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    run = space * 1_000_000
    texts = [f"x{run}y", f"{run}\t z", f"x{run}", f"a{run}\x1c{run}", f"b {run[:70_000]} c{run[:65_535]}d"]
    got = packing.token_pieces(table(spark, list(enumerate(texts))), capacity=1 << 30).collect()
    wanted = set()
    for n, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        wanted.add((n, 0, 0, len(ids), zlib.crc32(ids)))
    assert {tuple(r) for r in got} == wanted


def test_queries_read_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from jetframe.llm import registry

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    rows = [(0, f"a {end} b"), (1, end * 2), (2, f"x  {end}  y <|endoftext| >"), (3, f"{end}\n"), (4, None)]
    rows += [(5, f"a{' ' * 70_000}{end}{' ' * 70_000}{end}b"), (6, "<|<|endoftext|>|>"), (7, "plain")]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = Counter()
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        for piece, length in enumerate(packing.piece_lengths(len(ids), packing.CAPACITY)):
            wanted[doc_id, piece, start, length, zlib.crc32(ids[start : start + length])] += 1
            start += length
    query = registry.queries()["op10_best_fit_packing"](spark, str(tmp_path))
    stage = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, str(tmp_path))
    for got in (query, stage):
        assert Counter(tuple(r)[:5] for r in got.collect()) == wanted


def reference_codec():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces_codec.default_model())


CODEC = pieces_codec.codec(pieces_codec.default_model())
MODEL = reference_codec()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("abe the\n.", max_size=80))
def test_codec_equals_library(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == MODEL.encode(text)
    assert CODEC.decode(ids) == text.replace(pieces_codec.MARK, " ")


def test_codec_on_tables(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "a" * 5000), (5, "  \u2581 x\x00y"), (5, "x"), (None, "n")]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in pieces_codec.encode_and_back(docs.filter("text <> 'x'")).collect()}
    for doc_id, text in rows[:5]:
        if text is not None:
            ids = np.array(MODEL.encode(text), "<u4")
            row = got[doc_id]
            assert (row["n_pieces"], row["ids_crc32"]) == (len(ids), zlib.crc32(ids))
            assert row["round_trip"] == (pieces_codec.MARK not in text)
    back = pieces_codec.decode_documents(pieces_codec.encode_documents(docs)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(
        (i, (t or "").replace(pieces_codec.MARK, " ")) for i, t in rows
    )
    assert pieces_codec.encode_and_back(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "#", ""]), st.text("\\#</turn>eaé \n:", max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    examples = list(chat.examples_of(turns))
    if not turns:
        assert not examples
        return
    assert chat.parse(examples[-1][1]) == turns
    trained = [(p, chat.unescape(t[a:b])) for p, t, a, b in examples if p is not None]
    assert trained == [(n, t) for n, (r, t) in enumerate(turns) if r == "assistant"]
    for place, text, _, end in examples:
        wanted = turns if place is None else turns[: place + 1]
        assert chat.parse(text) == wanted and end <= len(text)


def test_chat_on_tables(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é"), (1, 2, "user", None), (2, 0, "user", "u"), (2, 0, "user", "u")]
    rows += [(3, n, "assistant" if n % 2 else "user", f"t{n}" * 50) for n in range(300)]
    rows += [(None, 0, None, None), (4, None, "assistant", "")]
    table_ = spark.createDataFrame(
        [(*r, 0, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, example int, target string"
    ).repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.prefix_examples(chat.with_hostile(table_))).collect()}
    rows += [(-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)]
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.prefix_examples(table_.limit(0)).count() == 0


def brute_anchors(spark, text):
    """Closed syncmers by definition: (start, k-mer), the order of s-mers taken from the engine."""
    k, s = fingerprint.K, fingerprint.S
    grams = [text[i : i + s] for i in range(len(text) - s + 1)]
    rows = [(n, *g) for n, g in enumerate(grams)]
    if not rows:
        return []
    names = [f"c{n}" for n in range(s)]
    frame = spark.createDataFrame(rows, "n int, " + ", ".join(f"{c} string" for c in names))
    h = [f"xxhash64({c})" for c in names]
    value = f"xxhash64(xxhash64({h[0]}, {h[1]}), xxhash64({h[2]}, {h[3]}))"
    order = {r["n"]: r["v"] for r in frame.selectExpr("n", f"{value} AS v").collect()}
    out = []
    for start in range(len(text) - k + 1):
        inner = [order[start + j] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(start)
    return out


@pytest.mark.parametrize("text", ["", "short", "a" * 60, "The quick brown fox, über alles 中文字 jumps over 13 dogs. " * 2])
def test_anchors_are_closed_syncmers(spark, text):
    found = fingerprint.anchors(table(spark, [(1, text)])).collect()
    assert sorted(r["position"] for r in found) == brute_anchors(spark, text)


def fingerprints(spark, rows):
    return fingerprint.fingerprint_edits(table(spark, rows)).collect()


def test_fingerprint_edits(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gämma", "delta", "epsilon", "中文", "z"]
    rows = [(3 * n, " ".join(rng.choices(words, k=rng.choice([1, 4, 30, 200])))) for n in range(80)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 20_000), (1003, rows[4][1]), (-5, "first text of all " * 4)]
    ordered = sorted(rows)
    got = {r["doc_id"]: r for r in fingerprints(spark, rows)}
    alone = []
    for n, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        row = got[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        alone.append((doc_id, edited))
    # The edited fingerprint, built from known anchors and the seam, is that of the edited text.
    direct = {r["doc_id"]: r["fingerprint"] for r in fingerprints(spark, alone)}
    assert {i: r["edited_fingerprint"] for i, r in got.items()} == direct
    assert got[12]["fingerprint"] == got[1003]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 500 and r["doc_id"] < 1000]
    assert np.mean([r["near_edited"] for r in long]) > 0.6


def test_fingerprint_edges(spark):
    one = fingerprints(spark, [(1, "only one document here, its own next")])[0]
    assert one["near_next"] == 1.0
    rows = fingerprints(spark, [(None, "null id " * 9), (None, "null id " * 9), (2, "b" * 50), (2, "c" * 50)])
    assert len(rows) == 4 and all(r["near_next"] is not None for r in rows)
    assert len(fingerprints(spark, [(None, "x"), (None, "y")])) == 2
    assert fingerprint.fingerprint_edits(table(spark, [(1, "a")]).limit(0)).count() == 0


def test_fingerprint_uses_one_shuffle_and_no_python(spark):
    plan = fingerprint.fingerprint_edits(table(spark, [(1, "a"), (2, "b")]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning") == 1 and "Python" not in text and "Arrow" not in text
