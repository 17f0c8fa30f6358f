"""Which keywords of a table stand in which texts, for keyword tables of any size.

The keywords are dealt into blocks of bounded size.  A block becomes one multi-pattern automaton (a
trie with failure and output links), which reads a text once, character by character, whatever
number of keywords it holds: the cost is the length of the text plus the places found.  The texts
are scanned once for each block and never shuffled; what leaves a task is (text key, keyword number).
A block travels as a broadcast of at most ``BLOCK_CHARS`` characters (a longer keyword is a block of its own).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.session import materialize

BLOCK_CHARS = 1 << 20       # characters of the keywords of one block


class Automaton:
    """States are numbers; state 0 is the root.  ``step[s]`` maps a character to the next state, ``fail[s]`` is the
    state of the longest proper ending of s that begins a keyword, ``ends[s]`` the keyword that is
    s, ``link[s]`` the next state on the way of failures that is a keyword."""

    def __init__(self, keywords: Iterable[tuple[int, str]]):
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for number, word in keywords:
            s = 0
            for c in word:
                t = self.step[s].get(c)
                if t is None:
                    t = self.step[s][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(-1)
                s = t
            self.ends[s] = number
        self.fail, self.link = [0] * len(self.step), [0] * len(self.step)
        todo = deque(self.step[0].values())
        while todo:                                     # by length, so that shorter states are complete
            s = todo.popleft()
            for c, t in self.step[s].items():
                f = self.fail[s]
                while f and c not in self.step[f]:
                    f = self.fail[f]
                self.fail[t] = self.step[f].get(c, 0) if s else 0
                todo.append(t)
            f = self.fail[s]
            self.link[s] = f if self.ends[f] >= 0 else self.link[f]

    def found(self, text: str) -> set[int]:
        """The numbers of the keywords that stand in ``text``."""
        step, fail, link, ends = self.step, self.fail, self.link, self.ends
        out: set[int] = set()
        seen: set[int] = set()                          # states whose keywords are all in ``out``
        s = 0
        for c in text:
            t = step[s].get(c)
            while t is None and s:
                s = fail[s]
                t = step[s].get(c)
            s = t or 0
            k = s if ends[s] >= 0 else link[s]
            while k and k not in seen:
                seen.add(k)
                out.add(ends[k])
                k = link[k]
        if ends[0] >= 0:
            out.add(ends[0])                            # the empty keyword stands in every text
        return out


def keyword_blocks(keywords: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """Distinct ``keyword`` rows with a number ``kid`` and a ``block``; how many blocks there are.  No block
    but those of a single keyword is larger than ``block_chars``."""
    from pressroom.operators.numbering import number_rows

    words = keywords.select("keyword").where(F.col("keyword").isNotNull()).distinct()
    size = F.length("keyword") + 1
    total = words.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if not total:
        return words.withColumn("kid", F.lit(0).cast("long")).withColumn("block", F.lit(0)).limit(0), 0
    words = materialize(number_rows(words, ["keyword"], base=0, col="kid"))
    blocks = max(1, -(-2 * int(total) // block_chars)) if total > block_chars else 1
    while True:
        dealt = words.withColumn("block", F.pmod(F.xxhash64("keyword"), F.lit(blocks)).cast("int"))
        over = dealt.groupBy("block").agg(F.sum(size).alias("n"), F.count("*").alias("k")).where((F.col("n") > block_chars) & (F.col("k") > 1))
        if not over.head(1):
            return dealt, blocks
        blocks *= 2


def keyword_hits(docs: DataFrame, keywords: DataFrame, key: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, keyword) for each text and each distinct keyword that stands in its lower-cased form."""
    dealt, blocks = keyword_blocks(keywords, block_chars)
    kind = docs.schema[key].dataType.simpleString()
    lowered = docs.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_text")).where("_text is not null")
    hits = None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("kid", "keyword").collect()     # one block, of bounded size
        if not rows:
            continue
        sent = docs.sparkSession.sparkContext.broadcast([(r["kid"], r["keyword"]) for r in rows])

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = None
            for b in batches:
                if machine is None:
                    machine = Automaton(sent.value)
                row, kid = [], []
                for i, t in enumerate(b.column(1)):
                    got = machine.found(t.as_py())
                    row.extend([i] * len(got))
                    kid.extend(got)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(kid, pa.int64())], names=["_key", "kid"])

        part = lowered.mapInArrow(scan, f"_key {kind}, kid long")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return docs.select(F.col(key), F.lit("").alias("keyword")).limit(0)
    return hits.join(dealt.select("kid", "keyword"), "kid").select(F.col("_key").alias(key), "keyword")
