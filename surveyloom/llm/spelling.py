"""Spelling variants of a corpus' words, found in a trie over letter counts.

A word's vector counts its letters by group, a group being the low five bits of the letter's Latin-1 code, common letters
first. Words one code point apart differ by a surplus of one at most and a deficit of one at most over all groups. The top
of the trie is a table: nodes are counts of the first groups, nodes of more than `most` words are split by further groups,
and every word is sent to the nodes that its budget reaches. In a node's task the rest of the trie is searched depth first:
the words looked up go down together, each with what is left of its surplus and deficit; at leaves words are compared.

Words are counted per task before they are shuffled. Nothing but counts of rounds comes to the driver.

Edge cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count again; of near words
with the same n the smallest comes first; an empty table gives no rows; other columns of `docs` are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

GROUPS = 32
#: Letters from common to rare, then the groups that only accented letters fall into.
ORDER = [ord(c) & 31 for c in "eainorstlcdumhgpbyfvwkxzqj"] + [0, 27, 28, 29, 30, 31]
#: Groups that nodes of each level are made of, words that a node may hold before it's split, and look-ups a task gets.
DEPTHS, MOST, LOOKED_UP = (4, 8, 16, GROUPS), 16_384, 65_536
#: Different words that a task counts before it passes their counts on.
KEPT = 400_000
#: Pairs of vectors that are compared at once, and words under a trie node that aren't split any more.
BLOCK, LEAF = 1 << 17, 24


def _letters() -> bytes:
    """Latin-1 bytes as letters, A-Z in small letters; all else is a space."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = out[65:91] = np.arange(97, 123)
    out[192:] = np.arange(192, 256)
    return out.tobytes()


LETTERS = _letters()


def _counted(least: int, one_in: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def made() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                lead = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                for word, n in Counter(text.as_py().encode("latin-1", "replace").translate(LETTERS).split()).items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), lead)
                    if h % one_in == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < least:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > KEPT:
                    yield made()
                    total = {}
        if total:
            yield made()

    return counted


def words(docs: DataFrame, least: int = 6, often: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): runs of letters, A-Z in small letters, of at least `least` code points that occur `often` times.

    Where `one_in` divides the crc32 of `<doc_id>:<run>`, one code point of the run is left out first.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_counted(least, one_in), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def vectors(latin: list[bytes]) -> np.ndarray:
    """A row of counts by group (ORDER) for each word; counts beyond 126 stay there, which keeps differences within one."""
    row = np.repeat(np.arange(len(latin)), [len(w) for w in latin])
    letters = np.frombuffer(b"".join(latin), np.uint8)
    counts = np.bincount(row * GROUPS + (letters & 31), minlength=len(latin) * GROUPS).reshape(-1, GROUPS)
    return np.minimum(counts, 126).astype(np.int8)[:, ORDER]


def _with_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in counts], pa.binary())], names=["word", "n", "v"])


def _moves(known: int, depth: int):
    """Rows with a node of `known` counts (and budgets left) to all nodes of `depth` counts within reach."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int8).reshape(-1, GROUPS)
            node = np.concatenate([np.frombuffer(b"".join(batch.column("node").to_pylist()), np.int8).reshape(len(own), known), own[:, known:depth]], axis=1)
            more, less = (batch.column(c).to_numpy().astype(np.int8) for c in ("more", "less"))
            nothing = (np.arange(len(own)), node, more, less)
            found = [nothing]
            for g in range(known, depth):
                grown = _step(nothing, g, True)
                found += [grown, _step(nothing, g, False)]
                found += [_step(grown, h, False) for h in range(known, depth) if h != g]
            for rows, nodes, ups, downs in found:
                if len(rows):
                    kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in ("word", "n", "v")]
                    arrays = [*kept, pa.array([r.tobytes() for r in nodes], pa.binary()), pa.array(ups.astype(np.int32)), pa.array(downs.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["word", "n", "v", "node", "more", "less"])

    return moved


def _step(state: tuple, group: int, up: bool) -> tuple:
    """Those of (row, node, more, less) that can spend one on a group, after they did."""
    rows, node, more, less = state
    can = (more > 0) if up else (less > 0) & (node[:, group] > 0)
    node = node[can]
    node[:, group] += 1 if up else -1
    return rows[can], node, more[can] - up, less[can] - (not up)


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether b is a with one letter replaced or, if longer by one, inserted."""
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return i < len(b) and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def search(known: np.ndarray, known_words: list[bytes], asked: np.ndarray, asked_words: list[bytes]) -> Iterator[tuple[int, int]]:
    """(asked, known) for words one replaced letter apart (the smaller asked) and for known words with one letter more.

    known: vectors in lexicographic order. A node of the trie is a run of them with equal counts so far.
    """
    length, wanted = np.array([len(w) for w in known_words]), np.array([len(w) for w in asked_words])

    def compared(low: int, high: int, who: np.ndarray) -> Iterator[tuple[int, int]]:
        for at in range(0, len(who), max(1, BLOCK // (GROUPS * (high - low)))):
            some = who[at : at + max(1, BLOCK // (GROUPS * (high - low)))]
            apart = np.abs(known[low:high, None] - asked[None, some]).sum(2)
            longer = length[low:high, None] - wanted[None, some]
            for k, q in zip(*np.nonzero(((longer == 1) & (apart <= 1)) | ((longer == 0) & (apart <= 2)))):
                a, b = asked_words[some[q]], known_words[low + k]
                if (len(a) < len(b) or a < b) and one_apart(a, b):
                    yield int(some[q]), low + int(k)

    def looked_up(low: int, high: int, who: np.ndarray) -> Iterator[tuple[int, int]]:
        """A leaf of many words with the same counts: spellings that could be there are made and looked up."""
        here = {known_words[k]: k for k in range(low, high)}
        letters = {bytes([c]) for w in here for c in w}
        for q in who.tolist():
            word = asked_words[q]
            inserted = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
            replaced = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
            for made in inserted | {r for r in replaced if word < r}:
                if made in here:
                    yield q, here[made]

    def walk(low: int, high: int, group: int, who: np.ndarray, more: np.ndarray, less: np.ndarray) -> Iterator[tuple[int, int]]:
        if not len(who):
            return
        if high - low <= LEAF:
            yield from compared(low, high, who)
            return
        if group == GROUPS:
            yield from looked_up(low, high, who)
            return
        values, starts = np.unique(known[low:high, group], return_index=True)
        for value, a, b in zip(values.tolist(), (low + starts).tolist(), [*(low + starts[1:]).tolist(), high]):
            change = value - asked[who, group].astype(np.int64)
            left, lacks = more - (change > 0), less - (change < 0)
            go = (np.abs(change) <= 1) & (left >= 0) & (lacks >= 0)
            yield from walk(a, b, group + 1, who[go], left[go], lacks[go])

    one = np.ones(len(asked), np.int8)
    yield from walk(0, len(known), 0, np.arange(len(asked)), one, one)


def _pairs(residents: pa.Table, visitors: pa.Table) -> pa.Table:
    def read(rows: pa.Table):
        latin = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
        return latin, np.frombuffer(b"".join(rows.column("v").to_pylist()), np.int8).reshape(-1, GROUPS)

    found: list[tuple[int, int]] = []
    if residents.num_rows and visitors.num_rows:
        residents = residents.sort_by([("v", "ascending"), ("word", "ascending")])
        own, known = read(residents)
        others, asked = read(visitors)
        found = list(search(known, own, asked, others))
    q, k = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
    columns = [pa.chunked_array([*a.take(i).chunks, *b.take(j).chunks], type=a.type) for a, i, b, j in (
        (visitors.column("word"), q, residents.column("word"), k), (residents.column("word"), k, visitors.column("word"), q), (residents.column("n"), k, visitors.column("n"), q),
    )]
    return pa.Table.from_arrays(columns, names=["word", "near", "near_n"])


def near_pairs(counts: DataFrame, most: int = MOST, looked_up: int = LOOKED_UP, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(word, near, near_n), both ways, for words of `counts` (word, n) that are one code point apart."""
    _row = "word string, n long, v binary, node binary, more int, less int"
    todo = materialise(counts.select("word", "n").mapInArrow(_with_vector, "word string, n long, v binary"))
    front = todo.select("*", F.lit(b"").alias("node"), F.lit(1).alias("more"), F.lit(1).alias("less"))
    whole, found, known = todo, [], 0
    for depth in depths:
        start: Column = F.substring("v", 1, depth)
        nodes = todo.groupBy(start.alias("node")).agg(F.count("*").alias("held"))
        last = depth == depths[-1]
        # Words that may be looked up in a node: those of all nodes within reach, for which the few nodes are asked, not the words.
        sizes = whole.groupBy(start.alias("node")).agg(F.count("*").alias("n"))
        padded = sizes.select(
            F.lit("").alias("word"), "n", F.concat("node", F.lit(bytes(GROUPS - depth))).alias("v"), F.lit(b"").alias("node"), F.lit(1).alias("more"), F.lit(1).alias("less"),
        )
        reached = padded.mapInArrow(_moves(0, depth), _row).groupBy("node").agg(F.sum("n").alias("asking"))
        split = (F.col("held") > most) & F.lit(not last)
        parts, pieces = F.ceil(F.col("asking") / looked_up).cast("int"), F.ceil(F.col("held") / most).cast("int")
        nodes = materialise(nodes.join(reached, "node").select("node", split.alias("split"), parts.alias("parts"), pieces.alias("pieces")))
        front = front.mapInArrow(_moves(known, depth), _row).join(nodes, "node")
        residents = todo.withColumn("node", start).join(nodes, "node")
        part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        piece = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
        each, every = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("parts", "pieces"))
        here = residents.where("not split").select("word", "n", "v", "node", piece.alias("piece"), each.alias("part"))
        there = front.where("not split").select("word", "n", "v", "node", part.alias("part"), every.alias("piece"))
        keys = ["node", "part", "piece"]
        found.append(materialise(here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(_pairs, "word string, near string, near_n long")))
        if last or nodes.where("split").isEmpty():
            break
        todo = materialise(residents.where("split").select("word", "n", "v"))
        front = materialise(front.where("split").select("word", "n", "v", "node", "more", "less"))
        known = depth
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of `forms` (word, form; null: none): where following forms ends. Steps double each round."""
    now = materialise(forms.select("word", F.col("form").alias("root")).where("root is not null"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
        now = now.select("word", "root")
    return forms.select("word").join(now.select("word", "root"), "word", "left").select("word", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame, times: int = 5, most: int = MOST) -> DataFrame:
    """A row per word: word, n, n_near, form (near word of largest n, if at least `times` the word's), form_n, root."""
    counts = materialise(words(docs))
    near = near_pairs(counts, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("top"))
    joined = counts.join(near, "word", "left")
    enough = -F.col("top.order") >= times * F.col("n")
    graded = materialise(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("top.near")).alias("form"), F.when(enough, -F.col("top.order")).alias("form_n"),
    ))
    return graded.join(roots(graded), "word")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 is a fold of bytes through its table of 256; near words share a rest after one code point of each (or of one) is left out.
ORACLE_SQL = {"op13_spelling": """
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
pairs AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL)),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2),
    lambda j: CAST(16 * (instr('0123456789ABCDEF', x[j]) - 1) + instr('0123456789ABCDEF', x[j + 1]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM pairs, tab),
results AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
graded AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
path AS (SELECT word, word AS root, form AS ahead FROM graded UNION ALL SELECT p.word, g.word, g.form FROM path p JOIN graded g ON g.word = p.ahead)
SELECT g.word, g.form, p.root, g.n, g.n_near, g.form_n FROM graded g JOIN path p ON p.word = g.word AND p.ahead IS NULL
"""}
QUERIES = {"op13_spelling": op13_spelling}
