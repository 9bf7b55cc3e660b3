import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from quirelake.llm import packing as K

PATH = K.vocabulary_path()


def test_knapsack_and_patterns():
    r = random.Random(1)
    for _ in range(20):
        sizes = np.array(sorted(r.sample(range(1, 40), r.randint(1, 12))))
        demand = np.array([r.randint(1, 60) for _ in sizes])
        got = K.patterns(sizes, demand, 64)
        assert (sum(c * n for c, n in got) == demand).all()
        assert all(c @ sizes <= 64 for c, _ in got)
        bins = []  # first fit, largest first
        for size in sorted((x for x, n in zip(sizes.tolist(), demand.tolist()) for _ in range(n)), reverse=True):
            k = next((k for k, room in enumerate(bins) if room >= size), None)
            if k is None:
                bins.append(64)
                k = len(bins) - 1
            bins[k] -= size
        assert sum(n for _, n in got) <= len(bins) * 1.05 + 2
    assert K.knapsack(np.array([3, 5]), np.array([3.0, 5.5]), 11)[1].tolist() == [2, 1]
    assert K.patterns(np.array([], int), np.array([], int), 64) == []


def test_encoder_equals_whole_text():
    whole = Tokenizer.from_file(PATH)
    encode = K.Encoder(PATH)
    for text in ["", " ", "  a", "a  b\n c", "é  x\t y", "it's 10 o'clock\n\n\n end ", " lead", "a  b 　c", "x" * 5000, "don't  'll 've", "\x1c a\x1f b", "\r\n a \r\nb", "q <|endoftext|> r", "zebra" * 100000]:
        assert encode([text])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_long_white_space():
    whole, encode = Tokenizer.from_file(PATH), K.Encoder(PATH)
    for space in (" ", "\n"):
        for text in (f"a{space * 2_000_000}b", space * 2_000_000):
            assert encode([text, "next"])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def verify(spark, rows):
    frame = spark.createDataFrame([(d, t, 5, 6) for d, t in rows], "doc_id long, text string, start int, class int")
    got = K.pack(frame, PATH, with_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    want = sorted(([(d, *whole.encode(t or "", add_special_tokens=False).ids, 1)] for d, t in rows), key=repr)
    docs = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(w[0]) - 1 for w in want)
    return docs, want, sequences


def test_round_trip(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "anble", "wher", "ê", "\n"]) for _ in range(int(r.paretovariate(0.9) * 20) % 9000))) for i in range(150)]
    docs, want, sequences = verify(spark, rows)
    for (w,) in want:
        parts = sorted(docs[w[0], len(w) - 1])
        assert [x for _, ids in parts for x in ids] == list(w[1:])
    used = sum(length for s in sequences.values() for _, length in s)
    assert used / (2048 * len(sequences)) > 0.9


def test_edges(spark):
    verify(spark, [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "word " * 30000)])
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_ids_of_a_whole_table_and_few_sequences(spark):
    """Every text of a table against `tokenizers`; the sequences are near the least number that could hold them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = Tokenizer.from_file(PATH)
    rows = K.pack(docs, PATH, with_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert all(got[r.doc_id] == [*whole.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect())
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * total / K.CAPACITY + 2


def test_other_vocabularies_go_through_tokenizers(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as source:
        made = json.load(source)
    assert len(K.ranks_of(made)) == 256 + len(made["model"]["merges"])
    assert K.ranks_of(made | {"normalizer": {"type": "Lowercase"}}) is None
    first, second, *rest = made["model"]["merges"]
    assert K.ranks_of(made | {"model": made["model"] | {"merges": [second, first, *rest]}}) is None
    lower = tmp_path / "lower.json"
    lower.write_text(json.dumps(made | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    assert K.Encoder(str(lower)).quick is None and K.Encoder(str(lower))(["ABC"]) == K.Encoder(PATH)(["abc"])


def test_a_difference_gives_up_the_quick_way():
    encode, whole = K.Encoder(PATH), Tokenizer.from_file(PATH)
    encode.quick = type("Wrong", (), {"encode_to_numpy": lambda self, text, **more: np.array([7], np.uint32)})()
    assert encode(["some text", "more"]) == [np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ("some text", "more")] and encode.quick is None
