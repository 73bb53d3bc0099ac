import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import hard, hard_rows, nothing
from tokenizers import Tokenizer

from helioquery.llm import records as R

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_whole_texts(plain):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", ",", ".", "a", "B", "é", "_", "7", "²", "'s", "'ll", "\xa0", "\t", "\r", "!", "日", "<|endoftext|>", "　", "\x1c", "\0", "😀", "-", "the", " x"]
    e = R.Encoder(PATH)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(5000)]
    assert [list(x) for x in e.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_bounded_memory_gives_the_same(plain, monkeypatch):
    monkeypatch.setattr(R, "_CACHE", 20)
    e = R.Encoder(PATH)
    for k in range(20):
        texts = [f"word{k} and {j} others, then\nmore." for j in range(20)]
        assert [list(x) for x in e.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(e.place) < 60


def test_hard_rows_round_trip(spark, plain):
    files = R.write_records(hard(spark), PATH)
    got = R.read_back(files).orderBy("start").collect()
    want = {}
    for r in hard_rows():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in hard_rows()], key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    row = files.first()
    doc_id, ids = R.read_record(row["path"], row["n_docs"] - 1)
    assert len(ids) and ids[-1] == 0


def test_damage_is_found(tmp_path):
    import io

    data = bytearray(R.frame(R.payload_of(5, np.array([1, 2, 3]), 2)))
    assert R.read_payload(next(R.read_records(io.BytesIO(bytes(data)))))[0] == 5
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(R.read_records(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError, match="truncated"):
        list(R.read_records(io.BytesIO(bytes(data[:-1]))))
    with pytest.raises(ValueError, match="index"):
        R.read_index(b"x" * 40)


def test_wide_ids_and_null_id():
    assert R.read_payload(R.payload_of(None, np.array([70_000]), 4)) == (None, np.array([70_000]))


def test_empty(spark):
    assert R.read_back(R.write_records(nothing(spark), PATH)).count() == 0
