"""Fill-in-middle against a plain version, its exact round trip, and odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from mediaflow.llm import fim


def plain(text, h, unit):
    units = list(text) if unit == "character" else text.splitlines(keepends=True)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("span", [1 << 20, 16, 5])
@pytest.mark.parametrize("unit", ["character", "line"])
def test_against_plain_version(monkeypatch, span, unit):
    monkeypatch.setattr(fim, "SPAN", span)
    rng = random.Random(span)
    texts = ["", "a", "<P>x", "é<", "<", "a<P", "日本<S", "x\ny\n\nz", "\n"] + ["".join(rng.choice("aé日😀<>PSM\n") for _ in range(rng.randrange(60))) for _ in range(2000)]
    h = np.array([[rng.randrange(1 << 32) for _ in range(4)] for _ in texts])
    got = fim.transformed(pa.array(texts), list(h.T), unit, 90, 20)
    assert list(zip(*(x.to_pylist() for x in got), strict=True)) == [plain(t, x.tolist(), unit) for t, x in zip(texts, h, strict=True)]
    assert fim.restored(got[4], got[1]).to_pylist() == texts
    assert set(got[1].to_pylist()) == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    long = "wörd 日本\n" * 300_000
    rows = [(None, None, "x"), (1, None, "x"), (2, "", "x"), (3, "abc", "x"), (3, "abc", "x"), (4, "abc", "x"), (5, long, "x"), (6, "a<M>b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Output string")
    made = fim.restore(fim.transform(docs))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_units", "middle_units", "output", "restored"]
    got = made.collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        digest = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain(text, [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], "character")
        assert r.restored == text
    none = docs.where("false")
    assert fim.restore(fim.transform(none)).count() == 0
