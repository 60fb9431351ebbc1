"""All places of many surface forms in texts, by an automaton in arrays.

Forms become an Aho-Corasick automaton: a row of next states for each state and class of characters, with failures resolved, so that a step is one
look-up. Texts are cut into stretches that overlap by the longest form, and all stretches of a batch take their steps together in numpy. The
table is broadcast if it has at most ``table_bytes``; more forms are dealt by hash into parts with a table, and a pass, each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a part's table of states, and characters of a stretch.
TABLE_BYTES, STRETCH = 64 << 20, 4096


class Automaton:
    """``next[state, class]``, the forms that end at a state, and the states to go on to for shorter ones."""

    def __init__(self, forms: list[str]):
        self.forms = sorted(set(forms) - {""})
        self.longest = max(map(len, self.forms), default=0)
        self.chars = np.array(sorted({ord(c) for f in self.forms for c in f}), np.uint32)
        width = len(self.chars) + 1  # the last class is any other character
        classes = {chr(c): i for i, c in enumerate(self.chars.tolist())}
        rows, depth, self.ends = [np.full(width, -1, np.int32)], [0], {}
        for number, form in enumerate(self.forms):
            state = 0
            for c in form:
                if rows[state][classes[c]] < 0:
                    rows[state][classes[c]] = len(rows)
                    rows.append(np.full(width, -1, np.int32))
                    depth.append(depth[state] + 1)
                state = int(rows[state][classes[c]])
            self.ends[state] = number
        self.next = np.stack(rows)
        fail = np.zeros(len(rows), np.int32)
        #: The nearest shorter state at which a form ends, 0 if there is none.
        self.shorter = np.zeros(len(rows), np.int32)
        has = np.isin(np.arange(len(rows)), list(self.ends))
        for state in np.argsort(depth, kind="stable").tolist():
            own = self.next[state] >= 0
            beside = self.next[fail[state]] if state else np.zeros(width, np.int32)
            fail[self.next[state][own]] = beside[own] if state else 0
            self.next[state] = np.where(own, self.next[state], beside)
            if state:
                self.shorter[state] = fail[state] if has[fail[state]] else self.shorter[fail[state]]
        self.form = np.full(len(rows), -1, np.int64)
        self.form[list(self.ends)] = list(self.ends.values())
        self.length = np.array([len(f) for f in self.forms], np.int64)

    def find(self, texts: list[str], stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, form, start) of every occurrence."""
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(codes) or not self.forms:
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        kind = np.where(self.chars[at] == codes, at, len(self.chars)).astype(np.int32)
        base = np.cumsum(sizes) - sizes
        count = -(-sizes // stretch)
        text = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        fresh = base[text] + place * stretch  # from here on a stretch's own places
        begin = np.maximum(base[text], fresh - (self.longest - 1))
        end = np.minimum(fresh + stretch, base[text] + sizes[text])
        order = np.argsort(begin - end, kind="stable")  # longest first, so those still running are a prefix
        text, fresh, begin, end = text[order], fresh[order], begin[order], end[order]
        state = np.zeros(len(text), np.int32)
        found: list[tuple] = []
        alive, length = len(text), end - begin
        for step in range(int(length[0])):
            while alive and length[alive - 1] <= step:
                alive -= 1
            spot = begin[:alive] + step
            now = state[:alive] = self.next[state[:alive], kind[spot]]
            hit = np.flatnonzero(((self.form[now] >= 0) | (self.shorter[now] > 0)) & (spot >= fresh[:alive]))
            at_state, of, where = now[hit], text[hit], spot[hit]
            while len(at_state):
                here = self.form[at_state] >= 0
                form = self.form[at_state[here]]
                found.append((of[here], form, where[here] + 1 - self.length[form] - base[of[here]]))
                at_state = self.shorter[at_state]
                of, where, at_state = of[at_state > 0], where[at_state > 0], at_state[at_state > 0]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def exact_recall(docs: DataFrame, forms: DataFrame, id_col: str = "doc_id", text_col: str = "text", form_col: str = "form", fold: bool = False, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, form, start, stop: every occurrence, overlapping ones too, in code points. ``fold`` compares lower case (where that keeps lengths).

    Null and empty forms and texts are found nowhere; a form that comes twice counts once; rows with equal ids are searched each. Only ids and texts are read.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    form, text = F.col(form_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    form, text = (F.lower(form), F.lower(text)) if fold else (form, text)
    listed = forms.select(form.alias("form")).where("form <> ''").distinct()
    chars, n = listed.agg(F.coalesce(F.sum(F.length("form")), F.lit(0)), F.count(F.lit(1))).first()
    alphabet = listed.select(F.explode(F.split("form", "")).alias("c")).distinct().count()
    parts = max(1, -(-(chars + 1) * 4 * (alphabet + 1) // table_bytes))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("form", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])

    def pass_over(part: int) -> DataFrame:
        mine = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([r.form for r in mine.collect()])  # a part has table_bytes at most, up to chance

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value)
            names = pa.array(automaton.forms, pa.string())
            for batch in batches:
                of, form, start = automaton.find(batch.column(1).to_pylist())
                stop = start + automaton.length[form] if len(form) else start
                yield pa.record_batch([batch.column(0).take(pa.array(of)), names.take(pa.array(form)), pa.array(start), pa.array(stop)], names=["doc_id", "form", "start", "stop"])

        return docs.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [pass_over(p) for p in range(parts)])
