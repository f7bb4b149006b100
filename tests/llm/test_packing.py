import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfield.llm.bpe import CachedBPE
from nearfield.llm.packing import Levels, pack
from nearfield.llm.textops import buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)
CODER = CachedBPE(PATH, most=300)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x23F, exclude_categories=("Cs",)), st.sampled_from("'strevlmd  \n\t12.,中😀")), max_size=40), max_size=6))
def test_ids_are_the_librarys(texts):
    texts = [*texts, "a<|endoftext|>b", "it's we'll 'S ' don'tx", "a  b   c\n\n d \n"]
    ids, before = CODER.encode(*buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[before[i] : before[i + 1]].tolist() == MODEL.encode(t, add_special_tokens=False).ids


def test_level_choice_is_least_sum_of_squares():
    rng = random.Random(3)
    levels = Levels(32, 0, 8192)
    for _ in range(400):
        size = rng.randint(1, 32)
        before = levels.count[1:32].copy()
        costs = {}
        for h in range(0, 33 - size):
            if h == 0 or before[h - 1]:
                after = before.copy()
                if h:
                    after[h - 1] -= 1
                if h + size < 32:
                    after[h + size - 1] += 1
                costs[h] = int((after**2).sum())
        if size < 32:
            assert costs[levels.choose(size)] == min(costs.values())
        levels.put((0, 0, np.zeros(size, np.uint32)))


def check(pieces, texts, capacity):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, text in texts.items():
        want = [*MODEL.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[doc], key=lambda p: p.start)
        got = [int(x) for p in own for x in np.frombuffer(p.ids, "<u4")]
        assert got == want and all(p.doc_tokens == len(want) for p in own)
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
        assert sum(p.length for p in own) <= capacity
    return sum(1 for own in by_seq.values() if sum(p.length for p in own) < capacity)


def test_every_id_is_in_one_piece(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["alpha", "été", "x9", "don't", "\n"]) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for i in range(80)}
    texts |= {100: None, 101: "", 102: "word " * 3000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).withColumns({"ids": F.lit(1), "start": F.lit("x"), "offset": F.lit(None)})
    pieces = pack(docs, PATH, capacity=128).collect()
    assert check(pieces, texts, 128) <= 3


def test_few_open_windows_close_early():
    levels = Levels(100, 0, most_open=4)
    for d in range(50):
        levels.put((d, 0, np.arange(60, dtype=np.uint32)))
        assert levels.open <= 4
    out = levels.end()
    assert sum(len(p[4]) for p in out) == 3000 and len({p[2] for p in out}) == 30


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert pack(spark.createDataFrame([], schema), PATH).count() == 0
    got = pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], schema), PATH).collect()
    assert sorted(str(p.doc_id) for p in got) == ["1", "1", "None"]
