import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tiebreak.llm import textarrays as ta

from .conftest import ODD_TEXTS, WORD


def split(texts, limit=64):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    found, hashes = [], {}
    for part, data, offsets in ta.chunks(batch, limit=limit):
        starts, ends, text = ta.words(data, offsets)
        h = ta.word_hashes(data, starts, ends)
        per = [[] for _ in range(part.num_rows)]
        for s, e, t, x in zip(starts, ends, text, h.tolist()):
            word = data[s:e].tobytes().decode()
            per[t].append(word)
            assert hashes.setdefault(word, x) == x
        found += per
    assert len(set(hashes.values())) == len(hashes)
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab ß\n\t\x0b\x1c€", max_size=40)), max_size=12))
def test_words_equal_the_pattern(texts):
    assert split(texts) == [WORD.findall(t or "") for t in texts]


def test_odd_texts_and_slices():
    assert split(ODD_TEXTS) == [WORD.findall(t or "") for t in ODD_TEXTS]
    batch = pa.RecordBatch.from_pydict({"text": ["aa bb", None, "cc"]}).slice(1)
    data, offsets = ta.buffers(batch.column("text"))
    assert data.tobytes() == b"cc" and offsets.tolist() == [0, 0, 2]


def test_rolling_depends_on_the_words_covered_only():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 4, 500).astype(np.uint64)
    for k in (1, 2, 3, 8, 13, 50):
        got = ta.rolling(h, k)
        assert len(got) == 500 - k + 1
        seen = {}
        for i, x in enumerate(got.tolist()):
            assert seen.setdefault(tuple(h[i: i + k].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)
    assert len(ta.rolling(h[:3], 4)) == 0
