"""Token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-level BPE whose merges are ranked, the encoding of a prefix ends in exactly one token ``t`` such
that the encoding of what precedes ``t`` ends in a token that stays apart from ``t`` when both are encoded
together. So the last token and the count at each byte follow from those at earlier bytes. The pre-tokens
that the library's splitting pattern makes are solved one by one and kept in a bounded table; a document's
store is the joined table entries: one signed byte for each code point, the change of the token count from
the prefix before it to the prefix that ends with it. Running sums of the store answer how many tokens any
prefix has, and where to cut a text for a budget, without encoding again.

Defined cases: a null or empty text has 0 tokens and an empty store. A null id is kept. Repeated rows each
get a row. Special-token strings in a text count as the library counts them by default: one token when
complete; a prefix that ends inside one is ordinary text. Columns other than id and text are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from kilnwork.llm.blocks import arrow_batches, id_schema

#: The splitting pattern of this family of tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose prefixes are split otherwise than the whole.
CUT_APART = {"'re", "'ve", "'ll"}
#: Entries of the table of solved pre-tokens before it starts anew.
TABLE_LIMIT = 800_000
NEVER = 1 << 30
SCHEMA = "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_store binary"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in shown}
    names.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return names


def unfit(spec: dict) -> None:
    """Raises for a tokenizer file that splits, rewrites or merges otherwise than this table does."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [name for name, holds in (
        ("model type", model.get("type", "BPE") != "BPE"),
        ("normalizer", spec.get("normalizer") is not None),
        ("pre-tokenizer", split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)),
        ("ignore_merges", bool(model.get("ignore_merges"))),
        ("dropout", bool(model.get("dropout"))),
        ("prefix or suffix of subwords", bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))),
        ("byte fallback", bool(model.get("byte_fallback"))),
        ("added tokens", any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and spec.get("normalizer") for t in spec["added_tokens"])),
    ) if holds]
    if wrong:
        raise ValueError(f"prefix counts need a plain byte-level BPE file; this one has another {', '.join(wrong)}")


class PrefixTable(dict):
    """Pre-token -> its part of a store. A missing one is solved on first use."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        unfit(spec)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for pair in self.merges:
            self.parts.setdefault(pair[0] + pair[1], pair)
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.split = regex.compile(SPLIT).findall
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.marks = sorted(special)
        self.apart: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """Encodes by applying the lowest-ranked merge until none applies."""
        while len(parts) > 1:
            ranks = [self.merges.get(p, NEVER) for p in zip(parts, parts[1:])]
            low = min(ranks)
            if low == NEVER:
                break
            a, b = parts[ranks.index(low)], parts[ranks.index(low) + 1]
            out, i = [], 0
            while i < len(parts):
                if parts[i] == a and i + 1 < len(parts) and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at a token's last (1) or first (0) byte while it is built, from the byte to the token, each with the rank of the merge that ends it."""
        known = self.edges.get((token, side))
        if known is None:
            chain, end, t = [], NEVER, token
            while True:
                chain.append((t, end))
                pair = self.parts.get(t)
                if pair is None:
                    break
                end, t = self.merges[pair], pair[side]
            known = self.edges[token, side] = chain[::-1]
        return known

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether both tokens come out again when their bytes are encoded together.

        Merges apply in the order of their ranks, as a merge ranks after those that made its parts. So one across
        the border comes first exactly if it ranks before the merges that end what stands on its two sides; of equal
        merges that overlap, the left one comes first.
        """
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > TABLE_LIMIT:
                self.apart.clear()
            if left:
                known, a, b, i, j = True, self.edge(left, 1), self.edge(right, 0), 0, 0
                while True:
                    (x, x_end), (y, y_end) = a[i], b[j]
                    across = self.merges.get((x, y), NEVER)
                    if across < x_end and across <= y_end and across != NEVER:
                        known = False
                        break
                    if x_end == y_end == NEVER:
                        break
                    if x_end <= y_end:
                        i += 1
                    else:
                        j += 1
            else:
                known = self.merged([right[i : i + 1] for i in range(len(right))]) == [right]
            self.apart[left, right] = known
        return known

    def counts(self, w: bytes) -> list[int]:
        """Token counts of the prefixes of one pre-token, for 0 to len(w) bytes."""
        ids, apart, stays, longest = self.ids, self.apart, self.stays, self.longest
        count, last = [0], [b""]
        for j in range(1, len(w) + 1):
            for i in range(j - 1, max(-1, j - longest - 1), -1):  # only one token fits, and it is short more often than long
                t = w[i:j]
                if t in ids and (apart.get((last[i], t)) or (last[i], t) not in apart and stays(last[i], t)):
                    count.append(count[i] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends at byte {j} of {w!r}")
        return count

    def __missing__(self, token: str) -> bytes:
        if len(self) > TABLE_LIMIT:
            self.clear()
        counts = self.counts(token.encode())
        if token.isascii():
            ends = counts[1:]
        else:
            at, ends = 0, []
            for c in token:
                at += len(c.encode())
                ends.append(counts[at])
        if token in CUT_APART:
            ends[1] = 2
        out = array("b", (b - a for a, b in zip([0, *ends], ends))).tobytes()
        if len(token) < 64:
            self[token] = out
        return out

    def total(self, text: str) -> int:
        return sum(sum(array("b", self[t])) for t in self.split(text))

    def plain(self, text: str) -> bytes:
        """The store of a text without special tokens."""
        store = b"".join(map(self.__getitem__, self.split(text)))
        runs = list(_RUN.finditer(text))
        if runs:  # a prefix that ends with a run of white space takes the run as one pre-token
            store = array("b", store)
            for m in runs:
                run, q = m.group(), m.end() - 1
                shift = self.total(run) - self.total(run[:-1]) - store[q]
                store[q] += shift
                store[q + 1] -= shift
            store = store.tobytes()
        return store

    def store(self, text: str) -> bytes:
        if self.special is None or not any(m in text for m in self.marks):
            return self.plain(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2 == 0:
                out.append(self.plain(part))
                before, base = part, sum(array("b", out[-1]))
            else:
                ends = [self.total(before + part[:c]) for c in range(1, len(part))] + [base + 1]
                out.append(array("b", (b - a for a, b in zip([base, *ends], ends))).tobytes())
        return b"".join(out)


_RUN = regex.compile(r"\s{2,}(?=\S)")
_tables: dict[str, PrefixTable] = {}


def table(path: str) -> PrefixTable:
    """One table for each worker process."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def tokens_at(store: bytes, n_chars: int) -> int:
    """How many tokens the first ``n_chars`` code points have."""
    return int(np.frombuffer(store, np.int8, min(n_chars, len(store))).sum(dtype=np.int64))


def cut_for_budget(store: bytes, budget: int) -> int:
    """The most code points that a prefix of at most ``budget`` tokens has."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(store, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_store: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, prefix_store of each row. ``keep_store`` False leaves the store null once the count is read from it."""
    arrow_batches(docs.sparkSession)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(tokenizer)
        for batch in batches:
            stores = [t.store(x) if x else b"" for x in batch.column(1).to_pylist()]
            sizes = pa.array([len(s) for s in stores], pa.int64())
            off = np.zeros(len(stores) + 1, np.int64)
            np.cumsum(sizes.to_numpy(), out=off[1:])
            run = np.zeros(off[-1] + 1, np.int64)
            np.cumsum(np.frombuffer(b"".join(stores), np.int8), out=run[1:])
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            kept = pa.array(stores if keep_store else [None] * len(stores), pa.binary())
            yield pa.record_batch([batch.column(0), n_bytes, sizes, pa.array(run[off[1:]] - run[off[:-1]]), kept], names=["doc_id", "n_bytes", "n_chars", "n_tokens", "prefix_store"])

    docs = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    return docs.mapInArrow(solve, id_schema(docs, SCHEMA))
