"""Personal data by patterns and by a linear-chain conditional random field over word-shape features.

The patterns give the base spans of four kinds; they always stay. The random field is trained from a small
labelled table (text, spans of kind, start, end), by gradient ascent on the likelihood with the forward and
backward recursions in numpy, in one task whose result is kept in the shared folder, and decodes every line of every text as a whole by Viterbi, many at once.
It adds spans of its kinds where they touch no base span: addresses and numbers written otherwise than the
patterns know, and secrets such as access keys and password or token values.

Tokens are runs of letters, runs of digits and single other characters; white space is a feature of the token
that follows. The scores of all tokens are computed over arrays of code points. Most tokens then are outside for
certain: no stretch that holds one can score above outside tags, by a bound on the stretch's sum. Viterbi runs
over what is left between them, which gives the likeliest tags of the whole line, however long it is.

Defined cases: null is the empty text, without spans. Work grows in proportion to a text, also one of a single long run
of characters. Offsets count code points. A null id is kept; repeated
rows each get a row. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.blocks import arrow_batches, id_schema
from kilnwork.llm.textscan import distinct, row_sums, slices, utf8
from kilnwork.sources.shared import kept_once

#: The base patterns, in the order of kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Kinds that the random field may add.
ADDED = ("email", "phone", "secret")
#: Code points that are scored together, more if a text is longer, and table cells of Viterbi at once, more if a run is longer.
PART, CELLS = 1 << 20, 1 << 18
SCHEMA = "doc_id long, base array<struct<kind:string,start:long,stop:long>>, spans array<struct<kind:string,start:long,stop:long>>"

# The same spans in work that grows with the text alone: an address is looked for around each @, and a number that
# starts within a run of digits never matches where the whole run doesn't.
_host = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_user = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_linear = {"ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), "card": re.compile(PATTERNS["card"]), "phone": re.compile(PATTERNS["phone"])}
_token = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_digits = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    d = "".join(_digits.findall(s))
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost addresses: at each @, all user characters before it that no address has taken, and the host after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _user:
            a -= 1
        host = _host.match(text, at + 1) if a < at else None
        if host:
            end = host.end()
            yield "email", a, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


#: A character without which the kind's pattern can't match.
_NEEDS = {"ip": ".", "card": "", "phone": "+"}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns by kind as listed, then start."""
    out = list(_addresses(text))
    for kind, pattern in _linear.items():
        if _NEEDS[kind] in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return out


# The random field. Tags: outside, then begin and inside of each kind.

TAGS = ["O", *(f"{p}-{k}" for k in ADDED for p in "BI")]
_TAG = {t: i for i, t in enumerate(TAGS)}
FEATURES = 1 << 14


def shape(token: str) -> str:
    """Upper, lower and digit runs with short runs' lengths; other characters stand for themselves."""
    if token.isdigit():
        return f"9{min(len(token), 9)}" if len(token) < 13 else "9long"
    if token.isalpha():
        n = "1" if len(token) == 1 else "s" if len(token) < 5 else "m" if len(token) < 12 else "l"
        return ("A" if token.isupper() else "a" if token.islower() else "Aa" if token[0].isupper() else "aA") + n
    return token


#: Words that introduce or join personal data.
CUES = frozenset("at dot mail email tel phone call fax mobile password passwd pwd pass token secret key api auth bearer access com org net".split())


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=4).digest(), "big") % FEATURES


@lru_cache(1 << 16)
def _code(kind: str, value: str) -> int:
    return _hash(f"{kind}|{value}")


def features(tokens: list[str], gaps: list[bool]) -> list[list[int]]:
    """Feature numbers of each token: its shape, its cue word, and those of its neighbours."""
    marks = [shape(t) + ("_" if g else "") for t, g in zip(tokens, gaps)]
    cues = [t.lower() if t.lower() in CUES else "" for t in tokens]
    run = [bool(re.fullmatch(r"[0-9a-f]{2,}|[0-9]{2,}|[A-Z0-9]{2,}|[0-9a-f]", t)) for t in tokens]
    mixed = []
    for i in range(len(tokens)):  # letters and digits without white space make one code
        a = i
        while a > 0 and not gaps[a] and tokens[a - 1].isalnum() and tokens[a].isalnum():
            a -= 1
        z = i
        while z + 1 < len(tokens) and not gaps[z + 1] and tokens[z + 1].isalnum() and tokens[z].isalnum():
            z += 1
        size = sum(map(len, tokens[a : z + 1]))
        mixed.append(f"{min(z - a, 3)}{'s' if size < 8 else 'm' if size < 14 else 'l'}{'h' if all(run[a : z + 1]) else 'w'}")
    get = lambda xs, i: xs[i] if 0 <= i < len(xs) else "#"
    out = []
    for i in range(len(tokens)):
        f = [_code(f"s{d}", get(marks, i + d)) for d in (-3, -2, -1, 0, 1, 2, 3)]
        f += [_code("c", mixed[i]), _code("c-", get(mixed, i - 1)), _code("c+", get(mixed, i + 1)), _code("cs", mixed[i] + marks[i]), _code("b", get(marks, i - 1) + marks[i]), _code("f", marks[i] + get(marks, i + 1))]
        f += [_code(f"w{d}", get(cues, i + d)) for d in (-2, -1, 0, 1, 2) if get(cues, i + d)]
        out.append(f)
    return out


def tokenize(text: str) -> tuple[list[str], list[int], list[int]]:
    found = [(m.group(), m.start(), m.end()) for m in _token.finditer(text)]
    return [t for t, _, _ in found], [a for _, a, _ in found], [z for _, _, z in found]


@dataclass
class Field:
    emit: np.ndarray  # FEATURES x tags
    move: np.ndarray  # tags x tags
    first: np.ndarray


def _forbidden() -> np.ndarray:
    """Inside tags follow only tags of their kind."""
    bad = np.zeros((len(TAGS), len(TAGS)), bool)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, s in enumerate(TAGS):
                bad[i, j] = s[2:] != t[2:] or s == "O"
    return bad


_BAD = np.where(_forbidden(), -1e4, 0.0)
_NO_START = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])


def _padded(sequences: list[list[list[int]]], emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores, windows x longest x tags, and the windows' lengths."""
    sizes = np.array([len(s) for s in sequences])
    out = np.zeros((len(sequences), int(sizes.max(initial=0)), len(TAGS)))
    flat = [f for s in sequences for f in s]
    width = np.array([len(f) for f in flat])
    codes = np.array([c for f in flat for c in f])
    ends = np.cumsum(width)
    sums = np.add.reduceat(emit[codes], ends - width, axis=0) if len(flat) else np.zeros((0, len(TAGS)))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(flat) else []] = sums
    return out, sizes


def train_field(table: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 120, rate: float = 0.15) -> Field:
    """Maximum likelihood with Adam and a small quadratic penalty, all sequences at once; recursions in scaled probabilities."""
    sequences, tags = [], []
    for text, spans in table:
        tokens, starts, ends = tokenize(text)
        label = [0] * len(tokens)
        for kind, a, z in spans:
            inside = [i for i in range(len(tokens)) if starts[i] >= a and ends[i] <= z]
            for n, i in enumerate(inside):
                label[i] = _TAG[("B-" if n == 0 else "I-") + kind]
        if tokens:
            sequences.append(features(tokens, [i == 0 or ends[i - 1] < starts[i] for i in range(len(tokens))]))
            tags.append(label)
    k = len(TAGS)
    field = Field(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k))
    if not sequences:
        field.first[0] = 1.0
        return field
    codes = np.array([c for s in sequences for f in s for c in f])
    width = np.array([len(f) for s in sequences for f in s])
    token = np.repeat(np.arange(len(width)), width)
    by_code = np.argsort(codes, kind="stable")
    first_of, _ = distinct(codes[by_code])
    used, token = codes[by_code][first_of], token[by_code]
    sizes = np.array([len(s) for s in sequences])
    n, longest = len(sizes), sizes.max()
    real = np.arange(longest) < sizes[:, None]
    truth = np.concatenate(tags)
    pairs = np.zeros((k, k))
    edge = np.zeros(len(truth), bool)
    edge[np.cumsum(sizes)[:-1]] = True
    np.add.at(pairs, (truth[:-1][~edge[1:]], truth[1:][~edge[1:]]), 1.0)
    starts = np.cumsum(sizes) - sizes
    firsts = np.bincount(truth[starts], minlength=k)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.emit, field.move, field.first)]
    e = np.ones((n, longest, k))
    for step in range(1, rounds + 1):
        scores = np.add.reduceat(field.emit[codes], np.cumsum(width) - width, axis=0)
        e[real] = np.exp(scores - scores.max(1, keepdims=True))
        move, first = np.exp(field.move + _BAD), np.exp(field.first + _NO_START)
        alpha, beta, scale = np.ones_like(e), np.ones_like(e), np.ones((n, longest))
        for t in range(longest):
            x = (alpha[:, t - 1] @ move if t else first) * e[:, t]
            scale[:, t] = x.sum(1)
            alpha[:, t] = np.where(real[:, t, None], x / scale[:, t, None], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], (e[:, t + 1] * beta[:, t + 1]) @ move.T / scale[:, t + 1, None], 1.0)
        after = e[:, 1:] * beta[:, 1:] * (real[:, 1:] / scale[:, 1:])[..., None]
        d_move = alpha[:, :-1].reshape(-1, k).T @ after.reshape(-1, k) * move - pairs
        p = (alpha * beta)[real]
        d_first = p[starts].sum(0) - firsts
        p[np.arange(len(truth)), truth] -= 1.0
        d_emit = np.zeros_like(field.emit)
        d_emit[used] = np.add.reduceat(p[token], first_of, axis=0)
        for x, g, m in zip((field.emit, field.move, field.first), (d_emit, d_move, d_first), moments):
            g = g / n + 1e-4 * x
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return field


def fitted(spark: SparkSession, table: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """The field of a table, trained by one task and kept in the shared folder under a digest of the table and of this module."""
    text = json.dumps(table)
    name = hashlib.sha256(f"{text}\n{inspect.getsource(inspect.getmodule(fitted))}".encode()).hexdigest()[:32]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                f = train_field([(x, [tuple(s) for s in spans]) for x, spans in json.loads(t)])
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (f.emit, f.move, f.first)], names=["emit", "move", "first"])

    row = kept_once(spark, f"pii-field-{name}", lambda: spark.createDataFrame([(text,)], "t string").coalesce(1).mapInArrow(train, "emit binary, move binary, first binary")).first()
    k = len(TAGS)
    return Field(*(np.frombuffer(bytes(x), np.float64).reshape(size) for x, size in zip(row, ((FEATURES, k), (k, k), (k,)))))


def viterbi(field: Field, sequences: list[list[list[int]]]) -> list[np.ndarray]:
    """The likeliest tags of each sequence, all sequences of the batch at once."""
    e, sizes = _padded(sequences, field.emit)
    return _best_tags(e, sizes, field.move + _BAD, field.first + _NO_START, np.zeros(len(TAGS)))


def _best_tags(e: np.ndarray, sizes: np.ndarray, move: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The likeliest tags, with scores of the first and last tags for all sequences or for each."""
    n, longest = len(sizes), int(sizes.max(initial=0))
    if not longest:
        return [np.zeros(0, int) for _ in sizes]
    best = first + e[:, 0]
    back = np.zeros((longest, n, len(TAGS)), np.int8)
    at_end = best.copy()
    for t in range(1, longest):
        x = best[:, :, None] + move
        back[t] = x.argmax(1)
        best = x.max(1) + e[:, t]
        live = sizes > t
        at_end[live] = best[live]
    out = np.zeros((n, longest), np.int8)
    tag = (at_end + last).argmax(1)
    for t in range(longest - 1, -1, -1):
        live = sizes > t
        out[live, t] = tag[live]
        tag = np.where(live, back[t, np.arange(n), tag], tag)
    return [out[i, : sizes[i]] for i in range(n)]


def small_labelled_table(rows: int = 1200, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented sentences with marked personal data in many spellings, and with numbers and codes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    letters = lambda a, z: "".join(pick("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(int(rng.integers(a, z))))

    mixed = lambda n: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def secret() -> str:
        """A value of letters, of hexadecimal digits in several lengths, of mixed letters and digits, or of groups."""
        plain = lambda a, z: letters(a, z).encode("ascii", "ignore").decode()
        return pick([
            plain(9, 12) + plain(4, 12), plain(9, 12) + plain(4, 12), plain(9, 12) + plain(4, 9).capitalize(), plain(9, 12) + digits(2),
            *(hexes(int(rng.choice([12, 16, 20, 24, 32, 36, 48, 64]))) for _ in range(4)), *(mixed(int(rng.integers(14, 45))) for _ in range(3)),
            "-".join(hexes(n) for n in (8, 4, 4, 4, 12)), mixed(22) + "==", mixed(11) + "/" + mixed(12) + "+" + mixed(6),
        ])

    def word() -> str:
        w = letters(1, 12)
        return pick([w, w, w, w.capitalize(), w + ",", w + "."])

    def piece() -> tuple[str, str | None]:
        """Text, kind; a secret's name is not part of it and is given apart by a leading mark."""
        plain = lambda a, z: letters(a, z).encode("ascii", "ignore").decode() or "ab"
        user, host = plain(2, 9), pick(["mail", "example", "post"]) + pick(["", digits(1)])
        t = int(rng.integers(0, 28))
        if t < 2:
            return f"{user}{pick(['', '.' + digits(2), '_' + user])}@{host}.{pick(['example.com', 'org', 'net'])}", "email"
        if t == 2:
            return f"{user}{pick([' at ', ' [at] ', ' (at) '])}{host}{digits(1)}{pick([' dot ', ' [dot] ', ' (dot) '])}{pick(['com', 'org', 'net'])}", "email"
        if t in (16, 17, 24, 25):  # without a digit, and with parts before the host
            n = int(rng.integers(0, 3))
            at, dot = [(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) ")][n]
            name = pick([user, user, user.capitalize(), f"{user}.{plain(2, 9)}", f"{user}_{plain(2, 9)}", f"{user}{dot}{plain(2, 9)}"])
            return name + at + dot.join([pick([plain(3, 10), host, host.rstrip("0123456789")]), *([plain(2, 9)] if rng.random() < 0.3 else []), pick(["com", "org", "net"])]), "email"
        if t in (18, 21, 26, 27):
            value = secret()
            cue = pick(["password", "passwd", "pwd", "secret", "token", "api_key", "api key", "access_token", "auth", "key"])
            form = int(rng.integers(0, 6))
            if form < 2:
                return f"{cue}={value}", "=secret"
            if form == 2:
                return f"{cue}: {value}", ":secret"
            if form == 3:
                return f"Bearer {mixed(int(rng.integers(20, 44)))}", " secret"
            mark = pick(["'", '"'])
            return f"{cue}{pick([' = ', '=', ': '])}{mark}{value}{mark}", f"{mark}secret"
        cue, same = pick(sorted(CUES)), letters(1, 9)
        if t == 19:  # cue words in prose
            return pick([
                f"at {word()}", f"{word()} at the {word()}", f"the {cue} of {word()}", f"{cue} {word()}", f"{cue}, {word()}", f"dot com {word()}", f"({cue})",
                " ".join(pick([word(), word(), cue, "at", "dot", "the"]) for _ in range(int(rng.integers(4, 14)))), f"{letters(2, 9)} = {letters(2, 9)}", f'"{letters(2, 12)} {letters(2, 12)}"',
            ]), None
        if t in (20, 22, 23):  # capitals, repetitions and other marks
            marks = "$%&#*!?+=~|/;:-_<>^@"
            return pick([
                " ".join(letters(1, 10) + pick(marks) * int(rng.integers(1, 5)) for _ in range(int(rng.integers(1, 12)))),
                " ".join(letters(1, 10) + pick(["", ",", "."]) + pick(marks) * 3 for _ in range(int(rng.integers(2, 14)))),
                " ".join(pick([letters(1, 10), letters(1, 10), cue, "at", "dot"]) + pick(["", "", pick(marks) * 3]) for _ in range(int(rng.integers(3, 14)))),
                " ".join(letters(1, pick([6, 10, 20])).upper() + pick(["", "!", "!!", "?"]) for _ in range(int(rng.integers(1, 7)))),
                " ".join(letters(1, pick([6, 10, 20])).upper() + pick([",", "", "."]) + pick(marks) * int(rng.integers(1, 4)) for _ in range(int(rng.integers(2, 9)))),
                " ".join([pick([same, same, cue, "at"])] * int(rng.integers(3, 40))), letters(8, 24).upper(), letters(12, 30), f"{letters(3, 9).capitalize()} {letters(12, 24)}",
                f"{word()} {letters(12, 24)} {word()}", f"{pick(marks)} {letters(12, 20)} {pick(marks)} {letters(3, 9)}",
            ]), None
        if t == 3:
            return f"+{pick(['1', '44', '49'])} ({digits(3)}) {digits(3)}-{digits(4)}", "phone"
        if t == 4:
            return pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]), "phone"
        if t == 5:
            return ".".join(str(int(rng.integers(1, 256))) for _ in range(4)), None
        if t == 6:
            return pick([digits(16), "-".join(digits(4) for _ in range(4)), " ".join(digits(4) for _ in range(4))]), None
        if t in (7, 8):
            return pick(["AKIA", "ASIA"]) + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "secret"
        if t == 9:
            return f"{pick(['gh', 'sk', 'pk', 'xox'])}{pick(['p', 'o', 'b', 's'])}{pick(['_', '-'])}{mixed(int(rng.integers(20, 44)))}", "secret"
        if t == 10:
            return f"{digits(1)}.{digits(1)}", None
        if t == 11:
            return pick([digits(4), digits(2), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}"]), None
        if t == 12:
            return pick([f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(3)},{digits(3)}", f"{digits(2)}%", f"CC BY-NC {digits(1)}.0", f"p. {digits(3)}", f"{letters(2, 5)}{digits(1)}"]), None
        if t == 13:
            return f"{digits(3)} {pick(['at', 'and', 'dot'])} {letters(2, 6)}", None
        if t == 14:
            return f"@{user}", None
        return word(), None

    table = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(0, 6))):
                text += word() + " "
            s, kind = piece()
            if kind:
                skip = 0 if kind[0].isalpha() else s.index(kind[0]) + 1
                skip += s[skip] == " "
                spans.append((kind.strip("=:'\" "), len(text) + skip, len(text) + len(s) - (kind[0] in "'\"")))
            text += s + pick([" ", " ", ". ", ", ", "\n"])
        for _ in range(int(rng.integers(0, 6))):
            text += word() + " "
        table.append((text, spans))
    return table


# The same tokens and features over arrays of code points.

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: Bits that hold of a token if they hold of all its characters.
_HEX, _CAPS, _ALPHA, _ISDIGIT, _NOT_UPPER, _NOT_LOWER, _NOT_CAPITAL, _NOT_SMALL = (1 << i for i in range(8))
_ODD = 32 + 0x110000


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, bits, and the lower-case letter if it is one of ASCII, of each code point."""
    c = np.arange(0x110000, dtype=np.uint32).view("U1")
    space, alnum, decimal = (f(c) for f in (np.strings.isspace, np.strings.isalnum, np.strings.isdecimal))
    kind = np.full(len(c), _OTHER, np.uint8)
    kind[alnum], kind[decimal], kind[space] = _LETTER, _DIGIT, _SPACE
    upper, lower = np.strings.isupper(c), np.strings.islower(c)
    title = np.strings.istitle(c) & ~upper
    bits = np.zeros(len(c), np.uint8)
    bits[0x30:0x3A] = bits[0x61:0x67] = _HEX
    bits[0x30:0x3A] |= _CAPS
    bits[0x41:0x5B] |= _CAPS
    for bit, holds in ((_ALPHA, np.strings.isalpha(c)), (_ISDIGIT, np.strings.isdigit(c)), (_NOT_UPPER, ~upper), (_NOT_LOWER, ~lower), (_NOT_CAPITAL, ~(upper | title)), (_NOT_SMALL, ~(lower | title))):
        bits[holds] |= bit
    bits[space] = 255
    small = np.zeros(len(c), np.uint8)
    small[0x61:0x7B] = small[0x41:0x5B] = np.arange(0x61, 0x7B)
    small[0x212A] = ord("k")
    return kind, bits, small


def _packed(word: str) -> int:
    return int.from_bytes(word.encode(), "little")


_CUE_WORDS = sorted(CUES, key=_packed)
_CUE_KEYS = np.array([_packed(w) for w in _CUE_WORDS], np.uint64)
_CUE_FIRST = np.zeros((256, 9), bool)
for _w in CUES:
    _CUE_FIRST[ord(_w[0]), len(_w)] = True
#: Names of ``mixed`` in the order of their numbers; the first stands beyond the line.
_MIXED = ["#", *(f"{n}{s}{h}" for n in range(4) for s in "sml" for h in "wh")]


def _shape_of(key: int, odd: list[str]) -> str:
    if key < 11:
        return f"9{key}" if key < 10 else "9long"
    if key < 27:
        return ("A", "a", "Aa", "aA")[(key - 11) // 4] + "1sml"[(key - 11) % 4]
    return chr(key - 32) if key < _ODD else odd[key - _ODD]


class Decoder:
    """A field with what its scores of tags above outside need; ``tags`` gives those of whole texts."""

    def __init__(self, field: Field):
        self.above = field.emit[:, 1:] - field.emit[:, :1]
        self.move, self.first = field.move + _BAD, field.first + _NO_START
        n = len(_MIXED)
        three = [np.stack([self._row(kind, m) for m in _MIXED]) for kind in ("c-", "c", "c+")]
        self.mixed = (three[0][:, None, None] + three[1][None, :, None] + three[2]).reshape(n**3, -1)
        self.cues = {d: np.stack([self._row(f"w{d}", w) for w in _CUE_WORDS]) for d in (-2, -1, 0, 1, 2)}
        # What a tag gains at most over outside tags by the step to it, at a stretch's start, within it and after its end.
        outside = self.move[0, 0]
        self.begin = np.maximum(self.move[0, 1:] - outside, self.first[1:] - self.first[0])
        self.within = self.move[1:, 1:].max(0) - outside
        self.leave = max(0.0, (self.move[1:, 0] - outside).max())

    def _row(self, kind: str, value: str) -> np.ndarray:
        return self.above[_code(kind, value)]

    def spans(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tags of the first token, starts and ends of what the field finds in code points; lines are apart."""
        kinds, all_bits, small = _characters()
        none = (np.zeros(0, np.int64),) * 3
        kind = kinds[chars]
        new = kind != _SPACE
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _OTHER)
        starts = np.flatnonzero(new)
        n = len(starts)
        if not n:
            return none
        last = kind != _SPACE
        last[:-1] &= new[1:] | (kind[1:] == _SPACE)
        ends = np.flatnonzero(last) + 1
        size, kind = ends - starts, kind[starts]
        bits = np.bitwise_and.reduceat(all_bits[chars], starts)
        gap = np.ones(n, bool)
        gap[1:] = ends[:-1] < starts[1:]

        # Marks, numbered as they occur.
        key = np.where(size < 13, np.minimum(size, 9), 10)
        lettered = (kind == _LETTER) & (bits & _ISDIGIT == 0)
        case = np.where((bits & (_NOT_UPPER | _NOT_SMALL)) == _NOT_SMALL, 0, np.where((bits & (_NOT_LOWER | _NOT_CAPITAL)) == _NOT_CAPITAL, 1, np.where(all_bits[chars[starts]] & _NOT_UPPER, 3, 2)))
        np.copyto(key, 11 + 4 * case + (size > 1) + (size > 4) + (size > 11), where=lettered)
        np.copyto(key, 32 + chars[starts].astype(np.int64), where=kind == _OTHER)
        odd: list[str] = []
        for i in np.flatnonzero(lettered & (bits & _ALPHA == 0)).tolist():
            odd.append(chars[starts[i] : ends[i]].tobytes().decode("utf-32-le", "surrogatepass"))
            key[i] = _ODD + len(odd) - 1
        key = 2 * key + gap
        have = np.zeros(int(key.max()) + 1, bool)
        have[key] = True
        number = np.cumsum(have)
        marks = ["#", *(_shape_of(k >> 1, odd) + "_" * (k & 1) for k in np.flatnonzero(have).tolist())]

        # Letters and digits without white space make one code.
        alnum = kind != _OTHER
        head = gap | ~alnum
        head[1:] |= ~alnum[:-1]
        group = np.flatnonzero(head)
        count = np.diff(np.append(group, n))
        whole = np.add.reduceat(size, group)
        run = alnum & ((bits & _HEX != 0) | ((bits & _CAPS != 0) & (size > 1)))
        code = 1 + 6 * np.minimum(count - 1, 3) + 2 * ((whole > 7) * 1 + (whole > 13)) + np.logical_and.reduceat(run, group)

        # Lines one after the other, with three places of none around each.
        line = np.searchsorted(np.flatnonzero(chars == 10), starts)
        fresh = np.ones(n, bool)
        fresh[1:] = line[1:] != line[:-1]
        at = np.arange(n) + 3 * np.cumsum(fresh)
        places = int(at[-1]) + 4
        m, x = np.zeros(places, np.int64), np.zeros(places, np.int64)
        m[at], x[at] = number[key], np.repeat(code, count)
        e = self._scores(m, x, marks)
        first = small[chars[starts]]
        cue = np.flatnonzero((kind == _LETTER) & (size < 9) & _CUE_FIRST[first, np.minimum(size, 8)])
        packed = np.zeros(len(cue), np.uint64)
        for i in range(8):
            here = size[cue] > i
            c = small[chars[np.minimum(starts[cue] + i, len(chars) - 1)]]
            packed |= np.where(here, np.where(c, c, 255), 0).astype(np.uint64) << np.uint64(8 * i)
        word = np.minimum(np.searchsorted(_CUE_KEYS, packed), len(_CUE_KEYS) - 1)
        is_cue = _CUE_KEYS[word] == packed
        cue, word = at[cue[is_cue]], word[is_cue]
        token = np.zeros(places, bool)
        token[at] = True
        for d, rows in self.cues.items():
            e[cue - d] += rows[word]
            e[at[~token[at + d]]] += self._row(f"w{d}", "#")

        tags = self._decode(e, token)
        b = np.flatnonzero(tags % 2 == 1)
        inside = (tags > 0) & (tags % 2 == 0)
        z = np.flatnonzero((tags[:-1] > 0) & ~inside[1:])
        return tags[b], starts[np.searchsorted(at, b)], ends[np.searchsorted(at, z)]

    def _scores(self, m: np.ndarray, x: np.ndarray, marks: list[str]) -> np.ndarray:
        """Scores of each place's tags above outside, without cue words."""
        k = len(marks)
        pair = m[:-1] * k + m[1:]
        if k < 1 << 12:
            have = np.zeros(k * k, bool)
            have[pair] = True
            keys = np.flatnonzero(have)
            number = np.zeros(k * k, np.int32)
            number[keys] = np.arange(len(keys), dtype=np.int32)
            pair = number[pair]
        else:
            keys, pair = np.unique(pair, return_inverse=True)
        a, b = keys // k, keys % k
        s = {d: self.above[[_code(f"s{d}", w) for w in marks]] for d in (-3, -2, -1, 0, 1, 2, 3)}
        both = [marks[i] + marks[j] for i, j in zip(a.tolist(), b.tolist())]
        before = s[-1][a] + s[0][b] + self.above[[_code("b", w) for w in both]]
        after = s[1][b] + self.above[[_code("f", w) for w in both]]
        n = len(_MIXED)
        own = x * k + m
        have = np.zeros(n * k, bool)
        have[own] = True
        here = np.zeros((n * k, self.above.shape[1]))
        for i in np.flatnonzero(have).tolist():
            here[i] = self._row("cs", _MIXED[i // k] + marks[i % k])
        e = np.zeros((len(m), self.above.shape[1]))
        mid = before[pair[2:-3]]
        mid += after[pair[3:-2]]
        mid += (s[-3][a] + s[-2][b])[pair[:-5]]
        mid += (s[2][a] + s[3][b])[pair[5:]]
        mid += self.mixed[(x[2:-4] * n + x[3:-3]) * n + x[4:-2]]
        mid += here[own[3:-3]]
        e[3:-3] = mid
        return e

    def _decode(self, e: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The likeliest tags of each place, outside between lines."""
        start = np.where(token, (e + self.begin).max(1), -1e6)
        more = np.where(token, (e + self.within).max(1), -1e6)
        # left: the most that a stretch up to a place gains; right: what it gains by going on.
        run = np.cumsum(more)
        left = run + np.maximum.accumulate(start - run)
        right = np.maximum.accumulate(run[::-1])[::-1] - run
        maybe = token & (left + right + self.leave > -1e-3)
        edge = np.diff(maybe.astype(np.int8), prepend=0, append=0)
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        tags = np.zeros(len(e), np.int8)
        size = z - a
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * size[order[j]] <= CELLS:
                j += 1
            mine = order[i:j]
            sizes = size[mine]
            rows = np.repeat(np.arange(j - i), sizes)
            cols = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            where = np.repeat(a[mine], sizes) + cols
            part = np.zeros((j - i, int(sizes.max()), len(TAGS)))
            part[rows, cols, 1:] = e[where]
            first = np.where(token[a[mine] - 1][:, None], self.move[0], self.first)
            last = np.where(token[z[mine]][:, None], self.move[:, 0], 0.0)
            tags[where] = np.concatenate(_best_tags(part, sizes, self.move, first, last))
            i = j
        return tags


def field_spans(field: Field | Decoder, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """What the random field finds in each text."""
    decoder = field if isinstance(field, Decoder) else Decoder(field)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and n + len(texts[j]) < PART:
            n += len(texts[j]) + 1
            j += 1
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[i : j - 1])])
        chars = np.frombuffer("\n".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
        tags, starts, ends = decoder.spans(chars)
        row = np.searchsorted(begin, starts, "right") - 1
        for tag, r, a, z in zip(tags.tolist(), row.tolist(), (starts - begin[row]).tolist(), (ends - begin[row]).tolist()):
            out[i + r].append((TAGS[tag][2:], a, z))
        i = j
    return out


def all_spans(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """Base spans, and those added that touch none; each kind's plausible sizes are checked."""
    extra = []
    taken = sorted((a, z) for _, a, z in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((z for _, z in taken), max))  # how far the spans up to each one go
    last = 0
    for a, z, kind in sorted({(a, z, kind) for kind, a, z in added}):
        n = sum(map(text.count, "0123456789", repeat(a), repeat(z)))
        fits = {"email": z - a >= 6, "phone": 7 <= n <= 15, "secret": z - a >= 8}.get(kind, False)
        i = bisect_left(starts, z)
        if fits and a >= last and (i == 0 or reach[i - 1] <= a):
            extra.append((kind, a, z))
            last = z
    rank = {k: i for i, k in enumerate((*KINDS, "secret"))}
    return sorted([*base, *extra], key=lambda s: (rank[s[0]], s[1]))


_TRIGGER = np.zeros(256, np.int8)
_TRIGGER[0x30:0x3A] = _TRIGGER[ord("@")] = 1


def find_pii(docs: DataFrame, table: list[tuple[str, list[tuple[str, int, int]]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans, all spans of each row, both by kind as listed and then start."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(fitted(spark, table if table is not None else small_labelled_table()))  # FEATURES x tags numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Decoder(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        struct = lambda xs: [[{"kind": k, "start": a, "stop": z} for k, a, z in x] for x in xs]
        for batch in batches:
            data, off = utf8(batch.column(1))
            seen = np.concatenate([row_sums(_TRIGGER[part], part_off) for _, _, part, part_off in slices(data, off)] or [np.zeros(0)])
            n = len(batch.column(0))
            base, spans = [[] for _ in range(n)], [[] for _ in range(n)]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for r, added in enumerate(field_spans(field, texts)):
                if seen[r]:  # no pattern does without a digit or @; the field does
                    base[r] = base_spans(texts[r])
                if base[r] or added:
                    spans[r] = all_spans(base[r], added, texts[r])
            yield pa.record_batch([batch.column(0), pa.array(struct(base), kind), pa.array(struct(spans), kind)], names=["doc_id", "base", "spans"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, id_schema(docs, SCHEMA))
