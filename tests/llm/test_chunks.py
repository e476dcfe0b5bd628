import random

import numpy as np
import pyarrow as pa

from triptopics.llm import chunks


def bounds(text):
    data = np.frombuffer(text, np.uint8)
    return chunks.chunk_bounds(data, np.array([0, len(data)]))


def slow_cuts(text):
    """Chunk ends by the definition: the gear sum of the last 32 bytes, least within REACH bytes."""
    h = [sum(int(chunks._GEAR[text[i - k]]) << k for k in range(min(32, i + 1))) % 2 ** 32 for i in range(len(text))]
    top = 2 ** 32 - 1
    around = lambda i: h[i] if 0 <= i < len(h) else top
    r = chunks.REACH
    return [i + 1 for i in range(len(text) - 1) if all(h[i] < around(j) for j in range(i - r, i)) and all(h[i] <= around(j) for j in range(i + 1, i + r + 1))]


def test_cuts_follow_the_definition():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(900))
    row, start, end = bounds(text)
    assert end[:-1].tolist() == slow_cuts(text) and start[0] == 0 and end[-1] == len(text)


def test_blocks_do_not_mix_rows_and_long_runs_are_cut():
    texts = ["x" * 5000, "", "short", "ab cd ef gh " * 60]
    col = pa.array(texts)
    data, off = chunks.text_view(col)
    row, start, end = chunks.chunk_bounds(data, off)
    for r, t in enumerate(texts):
        s, e = start[row == r], end[row == r]
        _, s1, e1 = bounds(t.encode())
        assert s.tolist() == s1.tolist() and e.tolist() == e1.tolist()
        assert (e - s).sum() == len(t) and (e - s <= chunks.MAX_BYTES).all()


def test_insertion_moves_only_near_boundaries():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(4000))
    _, _, a = bounds(text)
    _, _, b = bounds(text[:2000] + b"INSERTED" + text[2000:])
    assert {x for x in a if x < 1980} == {x for x in b if x < 1980}
    assert {x for x in a if x > 2060} == {x - 8 for x in b if x > 2068}


def test_passages_are_found_and_clean_texts_left(spark, no_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    rows = [(k, prose(100)) for k in range(20)] + [(100 + k, prose(30) + " " + passage + " " + prose(30)) for k in range(6)]
    rows += [(200, rows[0][1]), (201, None), (202, ""), (None, rows[1][1]), (300, rows[2][1] + " " + rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in chunks.repeated_passages(docs).collect()}
    assert set(got) == {101, 102, 103, 104, 105, 200, 300}
    texts = {d: (t or "").encode() for d, t in rows}
    for d, r in got.items():
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",")]
        assert r.n_spans == len(spans) and r.n_removed == sum(b - a for a, b in spans)
        earlier = b"\0".join(t for k, t in texts.items() if k is not None and k < d)
        for a, b in spans:
            assert texts[d][a:b] in earlier + b"\0" + texts[d][:a]
        if 100 < d < 200:
            assert r.n_removed > 0.5 * len(passage)
    assert got[200].n_removed == len(texts[200])
    assert chunks.repeated_passages(no_docs).count() == 0


def test_repeated_rows_lose_the_same_passage(spark):
    """A row that stands twice, or beside another text of its doc_id, loses the run that it loses alone."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(n))
    passage = prose(70)
    row, other = (7, prose(20) + " " + passage + " " + prose(20)), (7, prose(90))
    first = (1, prose(30) + " " + passage + " " + prose(30))
    spans = lambda rows: [(r.doc_id, r.n_repeats, r.n_removed, r.spans) for r in chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    alone = spans([first, row])
    assert len(alone) == 1 and alone[0][2] > 0.5 * len(passage)
    assert spans([first, row, row]) == spans([first, row, row, row]) == spans([first, row, other, other]) == alone
    assert sorted(r[0] for r in spans([first, first[:1] + ("x",), (9, first[1]), (9, first[1])])) == [9]


def test_passages_of_51_short_words_are_found_whole(spark):
    """Passages of 235 to 300 bytes whose whole chunks alone may stay below the length; every one is removed to its ends."""
    rng = random.Random(6)
    prose = lambda n, most: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, most))) for _ in range(n))
    rows, want, old = [], {}, 0
    for k in range(400):
        passage = prose(51, 5)
        rows.append((k, f"{prose(40, 9)} {passage} {prose(40, 9)}"))
        before = prose(40, 9) + " "
        rows.append((1000 + k, f"{before}{passage} {prose(40, 9)}"))
        want[1000 + k] = (len(before), len(before) + len(passage))
        _, s0, e0 = bounds(rows[-2][1].encode())
        _, s1, e1 = bounds(rows[-1][1].encode())
        earlier = {rows[-2][1][x:y] for x, y in zip(s0, e0, strict=True)}
        old += sum(y - x for x, y in zip(s1, e1, strict=True) if rows[-1][1][x:y] in earlier) < chunks.MIN_RUN_BYTES
    assert old > 0                                        # whole chunks alone lose some
    got = {r.doc_id: [tuple(map(int, x.split(":"))) for x in r.spans.split(",")] for r in
           chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert set(got) == set(want)
    for d, (a, b) in want.items():
        assert len(got[d]) == 1 and got[d][0][0] <= a and b <= got[d][0][1] and got[d][0][1] - got[d][0][0] <= b - a + 8
