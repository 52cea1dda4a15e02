"""Fill-in-middle by frames against the same by plain slices of the text."""

import hashlib
import random

import pytest

from tests.llm.helpers import frame, odd_documents
from tidewatch.llm.infill import cut, digests, frame_store, frames_of, infill, opened, restored, shut, stored, texts_of

MARKS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, seed=1):
    """The sample, its form, and the lengths of prefix and middle."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 90:
        return text, "plain", None, None
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", "spm", a, b - a
    return f"<P>{p}<S>{s}<M>{m}", "psm", a, b - a


SIGNS = ["a", "b", " ", "\n", "é", "中", "😀", "<", "P", "S", ">", "<P", "S>", "<M", "́", "\x00"]


def random_texts(n, seed=1):
    random.seed(seed)
    return ["".join(random.choices(SIGNS, k=random.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 3, 7, 65_536])
def test_any_cut_of_any_frames(size):
    for text in random_texts(300):
        frames = frames_of(text.encode(), size)
        assert (frames[-1][0] if frames else 0) == len(text)
        a, b = sorted(random.choices(range(len(text) + 1), k=2))
        parts = [b"".join(opened(d) for _, d in p).decode() for p in cut(frames, a, b)]
        assert parts == [text[:a], text[a:b], text[b:]]


def test_frames_without_a_cut_stay_as_they_are():
    frames = frames_of(("word " * 10_000).encode(), 1_000)
    prefix, middle, suffix = cut(frames, 2_500, 47_500)
    assert prefix[:2] == frames[:2] and middle[1:-1] == frames[3:47] and suffix[1:] == frames[48:]


@pytest.mark.parametrize("size", [2, 5, 65_536])
def test_samples_and_the_way_back(spark, size):
    texts = random_texts(600, 2) + ["has a <P> in it", "<", "<S", None, "", "x" * 3_000, "ü<" * 2_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    outputs = infill(frame_store(frame(spark, rows, "doc_id long, text string"), size=size), seed=1)
    whole = {r.doc_id: r for r in texts_of(outputs).collect()}
    found = {r.doc_id: r for r in digests(outputs).collect()}
    assert len(whole) == len(found) == len(rows)
    for doc_id, text in rows:
        text = text or ""
        output, form, prefix, middle = brute(doc_id, text)
        r, d = whole[doc_id], found[doc_id]
        assert (r.output, r.n, r.form, r.prefix_chars, r.middle_chars) == (output, len(text), form, prefix, middle)
        assert (d.output_sha256, d.restored_sha256, d.form) == (sha(output), sha(text), form)
    assert {r.form for r in whole.values()} == {"plain", "psm", "spm"}


def test_an_output_that_lost_a_mark_is_refused():
    with pytest.raises(ValueError):
        list(restored("psm", [shut(b"<P>prefix<S>suffix")]))


def test_odd_rows(spark):
    docs = odd_documents(spark).selectExpr("*", "'c' AS frames", "1 AS units", "true AS marked")
    got = sorted(map(str, (tuple(r) for r in digests(infill(stored(docs), 1)).collect())))
    expected = []
    for r in docs.collect():
        output, form, prefix, middle = brute(r.doc_id, r.text or "")
        expected.append((r.doc_id, len(r.text or ""), form, prefix, middle, sha(output), sha(r.text or "")))
    assert got == sorted(map(str, expected))
    assert digests(infill(stored(docs.limit(0)), 1)).count() == 0
