"""Cells of tables against a plain search, with merged cells, gaps and boxes over many tiles."""

import random

from ledgerlake.operators import grid as T

WORD = "doc INT, page INT, x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE, word STRING"
CELL = "doc INT, page INT, table_no INT, cell INT, cx0 DOUBLE, cx1 DOUBLE, cy0 DOUBLE, cy1 DOUBLE"


def brute(words, cells):
    out = set()
    for key in {c[:3] for c in cells}:
        own = sorted((c for c in cells if c[:3] == key), key=lambda c: c[3])
        xs = sorted({round(c[4], 1) for c in own})
        ends = [*xs, max(c[5] for c in own)]
        left = sorted((c for c in own if round(c[4], 1) == xs[0]), key=lambda c: (c[6], c[3]))
        for r, cell in enumerate(left, 1):
            y = (cell[6] + cell[7]) / 2
            for k in range(len(xs)):
                x = (ends[k] + ends[k + 1]) / 2
                hit = next((c for c in own if c[4] <= x <= c[5] and c[6] <= y <= c[7]), None)
                inside = [] if hit is None else [w for w in words if w[:2] == key[:2] and hit[4] <= (w[2] + w[3]) / 2 <= hit[5] and hit[6] <= (w[4] + w[5]) / 2 <= hit[7]]
                out.add((*key, r, k + 1, hit and hit[3], " ".join(w[6] for w in sorted(inside, key=lambda w: (round(w[4], 1), w[2], w[6])))))
    return out


def test_grid_equals_a_plain_search(spark):
    dice = random.Random(3)
    cells, words = [], []
    for doc in range(12):
        n = 0
        for row in range(6):
            col = 0
            while col < 5:
                span, down = dice.choice([1, 1, 1, 2, 3]), dice.choice([1, 1, 2])
                if dice.random() < 0.9 or col == 0:
                    cells.append((doc, 1, 1, n, col * 90.0, min(col + span, 5) * 90.0, row * 70.0, (row + down) * 70.0))
                    n += 1
                col += span
        for i in range(80):
            x, y = dice.randrange(-20, 480), dice.randrange(-20, 450)
            words.append((doc, 1, float(x), float(x + 21), float(y), float(y + 9), f"w{i}"))
    got = T.table_rows(spark.createDataFrame(words, WORD), spark.createDataFrame(cells, CELL)).collect()
    assert len(got) == len({tuple(r)[:5] for r in got})
    assert {(r["doc"], r["page"], r["table_no"], r["row"], r["col"], r["cell"], r["text"]) for r in got} == brute(words, cells)


def test_nulls_empty_tables_and_words_on_edges(spark):
    cells = [(1, 1, 1, 0, 0.0, 64.0, 0.0, 64.0), (1, 1, 1, 1, 64.0, 128.0, 0.0, 64.0), (1, 1, 1, 2, 9.0, 3.0, 0.0, 1.0)]
    words = [(1, 1, 60.0, 68.0, 60.0, 68.0, "edge"), (1, 1, None, 3.0, 1.0, 2.0, "x"), (1, 1, 1.0, 3.0, 1.0, 2.0, None), (2, 1, 1.0, 3.0, 1.0, 2.0, "y")]
    w, c = spark.createDataFrame(words, WORD), spark.createDataFrame(cells, CELL)
    assert {(r["cell"], r["text"]) for r in T.words_to_cells(w, c).collect()} == {(0, "edge"), (1, "edge")}  # a centre on the edge is in both
    assert T.table_rows(w, c.limit(0)).count() == 0
    assert {r["text"] for r in T.table_rows(w.limit(0), c).collect()} == {""}
