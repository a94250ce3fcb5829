"""Titles and words that meet in one task give what comparing all pairs gives, and few pairs have their edits counted."""

import random
import re

from surveyloom.operators import linkage, titles


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(pick, title, letters):
    out = list(title)
    for _ in range(pick.randint(0, 14)):
        at = pick.randrange(len(out) + 1)
        out[at : at + pick.randint(0, 1)] = pick.choices(letters, k=pick.randint(0, 1))
    return "".join(out)


def test_meet_like_all_pairs(monkeypatch):
    pick = random.Random(4)
    for least, letters, small in ((0.8, "ab", False), (0.8, "etaoin shr", True), (0.6, "é日a ", True), (0.9, "abcde ", False), (1.0, "abcde ", True)):
        for name in ("CELLS", "PIECE", "LANES") if small else ():
            monkeypatch.setattr(titles, name, 50)
        base = ["".join(pick.choices(letters, k=pick.randint(0, 60))) for _ in range(40)]
        ta = base + [changed(pick, t, letters) for t in base]
        tb = [changed(pick, t, letters) for t in base] + [pick.choice(base)[3:9] for _ in range(20)] + [None, ""]
        texts = [None if k % 7 == 0 else " ".join(["".join(pick.choices(letters, k=6)) for _ in range(5)] + [t or ""]) for k, t in enumerate(tb)]
        got = [x for i, j, share in titles.meet(ta, tb, texts, least, 0.5) for x in zip(i.tolist(), j.tolist(), share.tolist())]
        want, near = [], 0
        for i, t in enumerate(ta):
            words = [w for w in t.split(" ") if len(w) > 3]
            for j, u in enumerate(tb):
                share = sum(w in texts[j] for w in words) / len(words) if words and texts[j] is not None else 0.0
                held = bool(t and u) and (t in u or u in t)
                alike = bool(t and u) and distance(t, u) <= int((1 - least) * max(len(t), len(u)) + 1e-9)
                near += alike and not held
                if held or alike or share >= 0.5:
                    want.append((i, j, share))
        assert sorted(got) == want and (near or least == 1.0)


def test_few_titles_have_their_edits_counted(spark, monkeypatch):
    """All pairs of titles of like letters had their edits counted, by a join on author and year."""
    pick, counted, within = random.Random(1), [], titles._within
    monkeypatch.setattr(titles, "_within", lambda a, b, may: counted.append(len(a)) or within(a, b, may))
    own = ["".join(pick.choices("etaoin shrdlu", k=pick.randint(100, 120))) for _ in range(200)]
    pairs = [(i, j) for i, j, _ in titles.meet(own, [t[:50] + "x" + t[60:] for t in own], [None] * 200, 0.8, 0.75)]
    assert sorted((i, j) for a, b in pairs for i, j in zip(a.tolist(), b.tolist())) == [(i, i) for i in range(200)]
    assert 200 <= sum(counted) < 600
    df = spark.createDataFrame([(i, "p", 2000, t, t) for i, t in enumerate(own[:3])], "id long, author string, year int, title string, text string")
    plan = linkage.verified_pairs(df, df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join.*levenshtein", plan) and "Window" not in plan


def test_slices_of_both_sides_meet(spark, monkeypatch):
    monkeypatch.setattr(linkage, "SLICE", 3)
    monkeypatch.setattr(linkage, "SLICE_LETTERS", 100)
    monkeypatch.setattr(linkage, "RETURNED", 200)
    rows = [(i, "p" if i % 10 else None, 2000 + i % 3 if i % 11 else None, f"minas gerais {i % 4}", "serra do mar" if i % 2 else None) for i in range(60)]
    a = spark.createDataFrame(rows, "id long, author string, year int, title string, text string")
    b = a.selectExpr("cast(id as string) id", "author", "year", "title", "text")  # keys of another type
    got = sorted((r["a"], int(r["b"])) for r in linkage.verified_pairs(a, b).collect())
    assert got == [(i, j) for i in range(60) for j in range(60) if i != j and i % 10 and j % 10 and i % 11 and j % 11 and abs(i % 3 - j % 3) <= 1]
