import random
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import codepoints as C


def plain(text: str) -> str:
    """The form by whole-string calls, from the statement of the form."""
    text = text.replace("\r\n", "\n")
    hidden = set(map(chr, C.INVISIBLE))
    out = []
    for ch in text:
        kind = unicodedata.category(ch)
        if ord(ch) in C.LINE_BREAKS:
            out.append("\n")
        elif kind == "Zs" or ch in "\t⠀":
            out.append(" ")
        elif ch in hidden or kind == "Cc" or kind == "Cf" and ord(ch) not in C.SHOWN_FORMATS:
            continue
        else:
            out += [C.LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", C.LOOKALIKES.get(ch, ch)) if x not in hidden]
    return unicodedata.normalize("NFC", "".join(out))


def form(texts):
    return C.encode(C.consistent(C.decode(pa.array(texts, pa.string())))).to_pylist()


MARKS = "゙ְཱ̧̣̀́̈ͅ"
ODD = "aeoсеоАВéёﬁＡ１ 　​️ \r\n\t ​Ωσｶﾞ가각\U0001d5be한क़ẛୋÅ" + MARKS


@given(st.lists(st.text(alphabet=st.sampled_from(ODD), max_size=30), max_size=8))
@settings(max_examples=400, deadline=None)
def test_same_as_whole_string_calls(texts):
    assert form(texts) == [plain(t) for t in texts]


@given(st.lists(st.text(max_size=20), max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_unicode(texts):
    assert form(texts) == [plain(t) for t in texts]


def test_all_code_points_and_idempotence():
    texts = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    once = form(texts)
    assert once == [plain(t) for t in texts]
    random.seed(3)
    mixed = ["".join(random.choices(texts, k=40)) for _ in range(300)]
    assert form(form(mixed)) == [plain(plain(t)) for t in mixed]


def test_examples():
    assert form(["Ｐａｙ", "раураl", "é", "ﬁne", "a​b", "a b", "x\r\ny", "", "́", "Tab\tbed", "⚙️"]) == ["Pay", "paypal", "é", "fine", "ab", "a b", "x\ny", "", "́", "Tab bed", "⚙"]
    assert form(["Case", "a  b", "naïve", "“q”"]) == ["Case", "a  b", "naïve", "“q”"]


@given(st.lists(st.text(alphabet=st.sampled_from(ODD + "ßİ  \n"), max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_folded(texts):
    got = C.encode(C.folded(C.consistent(C.decode(pa.array(texts, pa.string()))))).to_pylist()
    assert got == [" ".join(plain(t).casefold().split()) for t in texts]


def test_slices_nulls_and_bad_bytes():
    arr = pa.array(["x", None, "é", "", "ǘ"])[1:]
    codes = C.decode(arr)
    assert C.encode(codes, np.array(arr.is_null())).to_pylist() == [None, "é", "", "ǘ"]
    bad = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 2, 3], np.int32).tobytes()), pa.py_buffer(b"a\xffb")])
    assert C.encode(C.decode(bad)).to_pylist() == ["a�", "b"]


def test_hashes_follow_content():
    a = C.hashes(C.decode(pa.array(["abc", "xabc", "abc", "", "a", "ab\0"])))
    assert a[0] == a[2] and len(set(a.tolist())) == 5
    v = np.array([1, 2, 3, 9, 1, 2, 3, 4])
    w = C.window_hashes(v, np.arange(6), 3, 5)
    assert w[0] == w[4] and len(set(w.tolist())) == 5
