"""Personal data: fixed forms by expression, and what a small conditional random field adds."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map

KINDS = ("email", "ip", "card", "phone")
TAGS = ("o", *KINDS)
#: The expressions of the base rules, written so that a long run is read once: e-mail addresses from their
#: @ on, with the longest local part before it; IP numbers from the first digit of a run.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
TELLING = re.compile("[0-9@]")
#: What a line the field reads must hold: all that it adds has seven digits or an address written out.
WRITTEN_AT = re.compile(r"[(\[{]\s*at\s*[)\]}]", re.I)
READ = re.compile(rf"[0-9@]|{WRITTEN_AT.pattern}", re.I)
EDGE = ".,;:!?\"'()[]{}<>#*$%&|"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, in order of kind and start."""
    out, last = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            out.append((0, start, last))
    if not TELLING.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def shape(word: str) -> str:
    """Kind of each character, runs of over three drawn together: ``+1`` is ``+d``, ``555-5433`` is ``ddd-D``."""
    kinds = "".join(
        "d" if "0" <= c <= "9" else ("X" if c.isupper() else "x") if c.isalpha() else c for c in word
    )
    return re.sub(r"(.)\1{3,}", lambda m: "D" if m[1] == "d" else m[1] + "+", kinds)


def outline(word: str) -> str:
    """The kinds of characters in turn, however many of each: ``x.x(x)x.x``, ``d-d``; marks at the end left out."""
    return "~" + re.sub(r"(.)\1+", r"\1", "".join("d" if "0" <= c <= "9" else "x" if c.isalpha() else c for c in word.rstrip(EDGE)))


def digit_count(word: str) -> str:
    """How many digits, and whether a zero is the first: what there is of a number in the word."""
    digits = _digits(word)
    return f"#{min(len(digits), 20)}{'z' if digits.startswith('0') else ''}"


class Field:
    """A linear-chain conditional random field over word shapes (own, previous and next word's).

    ``views`` are the ways a shape is taken; ``weights`` holds a table per view and place of the shape, ``moves`` the scores of one
    tag after another.
    """

    def __init__(self, shapes: dict[str, int], views: tuple = (shape,)):
        import numpy as np

        self.shapes, self.views = shapes, views  # 0: not seen in training, 1: no word
        self.weights = np.zeros((3 * len(views), len(shapes) + 2, len(TAGS)))
        self.moves = np.zeros((len(TAGS), len(TAGS)))

    def ids(self, lines: list[list[str]], known: dict[str, tuple[int, ...]]):
        """Shape numbers by view, one row a line, 1 before, after and between its end and the longest line's."""
        import numpy as np

        grid = np.ones((len(self.views), len(lines), max(map(len, lines)) + 2), dtype=np.int32)
        for row, words in enumerate(lines):
            for at, word in enumerate(words, 1):
                if (n := known.get(word)) is None:
                    n = known[word] = tuple(self.shapes.get(view(word), 0) for view in self.views)
                grid[:, row, at] = n
        return grid

    @staticmethod
    def places(grid) -> list:
        return [part for view in grid for part in (view[:, 1:-1], view[:, :-2], view[:, 2:])]

    def scores(self, grid):
        return sum(table[at] for table, at in zip(self.weights, self.places(grid), strict=True))

    def fit(self, lines: list[list[str]], tags: list[list[int]], steps: int = 80, rate: float = 0.2, penalty: float = 1e-3) -> None:
        """Maximise the penalised likelihood by Adam over all lines at once."""
        import numpy as np

        grid = self.ids(lines, {})
        n, width = grid.shape[1], grid.shape[2] - 2
        gold = np.zeros((n, width), dtype=np.int64)
        mask = np.zeros((n, width), dtype=bool)
        for row, t in enumerate(tags):
            gold[row, : len(t)], mask[row, : len(t)] = t, True
        places = self.places(grid)
        one = np.eye(len(TAGS))
        seen_moves = np.zeros_like(self.moves)
        both = mask[:, 1:]
        np.add.at(seen_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        state = [np.zeros_like(x) for x in (self.weights, self.weights, self.moves, self.moves)]
        add = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        for step in range(1, steps + 1):
            emit = self.scores(grid)
            forward, backward = np.empty_like(emit), np.zeros_like(emit)
            forward[:, 0] = emit[:, 0]
            for t in range(1, width):
                nxt = add(forward[:, t - 1, :, None] + self.moves, 1) + emit[:, t]
                forward[:, t] = np.where(mask[:, t, None], nxt, forward[:, t - 1])
            for t in range(width - 2, -1, -1):
                back = add(self.moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
                backward[:, t] = np.where(mask[:, t + 1, None], back, 0)
            total = add(forward[:, -1], 1)
            marginal = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
            gap = (one[gold] - marginal) * mask[:, :, None]
            grad_w = np.zeros_like(self.weights)
            for place, at in enumerate(places):
                np.add.at(grad_w[place], at[mask], gap[mask])
            pair = np.exp(
                forward[:, :-1, :, None] + self.moves + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
            )
            grad_m = seen_moves - pair[both].sum(0)
            for x, g, m, v in ((self.weights, grad_w, *state[:2]), (self.moves, grad_m, *state[2:])):
                g = g / n - penalty * x
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def decode(self, lines: list[list[str]], known: dict[str, int]) -> list[list[int]]:
        """The best tags of every line: Viterbi over batches of lines of like length."""
        import numpy as np

        out: list[list[int]] = [[] for _ in lines]
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto - at) * len(lines[order[upto]]) < 100_000:
                upto += 1
            part = [lines[i] for i in order[at:upto]]
            best = self._paths(self.scores(self.ids(part, known)), np.array([len(x) for x in part]))
            for i, path, words in zip(order[at:upto], best, part, strict=True):
                out[i] = path[: len(words)].tolist()
            at = upto
        return out

    def _paths(self, emit, lengths):
        import numpy as np

        n, width, _ = emit.shape
        came = np.zeros(emit.shape, dtype=np.int8)
        score = emit[:, 0]
        for t in range(1, width):
            step = score[:, :, None] + self.moves
            came[:, t] = step.argmax(1)
            score = np.where((t < lengths)[:, None], step.max(1) + emit[:, t], score)
        path = np.zeros((n, width), dtype=np.int8)
        tag = score.argmax(1)
        rows = np.arange(n)
        for t in range(width - 1, -1, -1):
            inside = t < lengths
            path[inside, t] = tag[inside]
            if t:
                tag = np.where(inside, came[rows, t, tag], tag)
        return path


def labelled(texts: list[str], around: int = 8) -> tuple[list[list[str]], list[list[int]]]:
    """Pieces of lines and tags from the base rules; forms without their plus sign or @ carry the label on."""
    lines, tags, plain = [], [], 0
    for text in texts:
        for line in text.split("\n"):
            spans = base_spans(line)
            words = list(TOKEN.finditer(line))
            if not words or (not spans and plain > len(lines) // 2 + 50):
                continue
            plain += not spans
            got = [next((k + 1 for k, a, b in spans if w.start() < b and a < w.end()), 0) for w in words]
            first = max(0, next((i for i, t in enumerate(got) if t), 0) - around)
            words, got = words[first : first + 3 * around], got[first : first + 3 * around]
            lines.append([w[0] for w in words])
            tags.append(got)
            if 4 in got and (at := next((i for i, w in enumerate(words) if got[i] == 4 and w[0].startswith("+")), None)) is not None:
                rest = [i for i in range(len(words)) if i != at]
                if any(got[i] == 4 for i in rest):  # the country's number left out
                    lines.append([words[i][0] for i in rest])
                    tags.append([got[i] for i in rest])
            if 1 in got:
                lines.append([w[0].replace("@", "(at)") for w in words])
                tags.append(got)
    return lines, tags


#: The labelled table: a line each, what is personal in it between braces behind its kind. Numbers that are none of it stand without.
TABLE = """
call {phone 030 1234567} after six
you can reach us at {phone (020) 7946 0958} or by post
Tel. {phone 0171/2345678} or mobile {phone 0151 23456789}
fax {phone 089-123456-78}, room 12
telephone: {phone 555-123-4567}, ask for Ann
phone {phone (555) 123-4567} in the morning
ring {phone 01 42 68 53 00} for a table
mon numéro est le {phone 06 12 34 56 78} le soir
tél. {phone 05.61.23.45.67} poste 3
mi teléfono es {phone 912 345 678} por favor
llame al {phone 91 234 56 78} hoy
móvil {phone 612345678} o fijo
ihre nummer ist {phone 0049 30 123456} gewesen
rufen sie {phone 030/12345-67} an
contact {phone 1-800-555-0199} free of charge
her number is {phone 555.867.5309} now
mobile {phone 07700 900123} any time
text {phone 07700900123} to join
write to {email jane.doe(at)example.org} for more
mail {email jdoe[at]example[dot]com} with it
mail us: {email info (at) example (dot) org} today
mail to {email lena.m [at] post.org} or ring
questions to {email info [at] firma.de} by friday
send it to {email anna.k(at)mail.example.de} soon
{email max(at)firma.de} oder per post
écrivez à {email marie (at) exemple.fr} merci
escriba a {email juan.perez(at)ejemplo.es} o llame
adresse: {email kontakt{at}beispiel.de} steht dort
the order 2023-0012345 was sent on 2024-05-13
invoice no 20240511 of 12,345.67 is due
version 10.15.7 of build 19H2026 came out
at 12:30 on 03.04.2021 in room 1204
the isbn is 978-3-16-148410-0 they say
between 1914 and 1918 some 20 000 000 died
the law of 25.05.2018 applies to 4 500 firms
pi is 3.14159265358979 and e 2.718281828
account 4532 1111 2222 3333 was closed
serial 4785380592391141 is not known
with 4316522678525456 from this on
number 2123465659789240 of the list
the key is 24be64439e3e49cf46b2d7c90f3602a3 there
token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff was found
a hash like 9f86d081884c7d659a2feaa0c55ad015 tells
look at chapter 7 on page 512 to 530
he stood at the door and put a dot on it
we met at ten at the old station
the score was 3-1 and then 21-19
latitude 52.520008 and longitude 13.404954
it weighs 1 234 567 grams or so
section 12.3.4.5 of part 2
ip 192.168.300.1 is none
the ratio 1/3 of 100/300
in 1999 and 2000 and 2001
postal code 10115 in the city
seat 14C of flight 2045
the 100 000 of 2010 and the 250 000 of 2020
from 08:15 to 17:45 each day
sizes 36 38 40 42 44 46
the file 20230401_123456.jpg is large
see 12345/67 and 890/12 of the acts
licensed under version 2.0 of it
"""
#: Lines made of each line of the table, with other lengths of its names and numbers.
VARIANTS = 8
KIND_OF_TABLE = re.compile(r"\{(email|ip|card|phone) ((?:[^{}]|\{at\})*)\}")


def _varied(line: str, number: int) -> str:
    """A line with its numbers a digit longer or shorter and the names in its addresses of another length: shapes are learned, not examples."""
    rng = random.Random(f"{line}{number}")

    def digits(m: re.Match) -> str:
        size = len(m[0]) if len(m[0]) > 6 else max(1, len(m[0]) + rng.choice((-1, 0, 0, 1)))
        return "".join(rng.choice("0123456789") for _ in range(size))

    def name(m: re.Match) -> str:
        return m[0] if m[0] in ("at", "dot", "com", "org", "net", "email") else "x" * rng.choice((2, 3, 5, 6))

    line = re.sub(r"[0-9]+", digits, line) if not re.search("[0-9][a-f]|[a-f][0-9]", line) else line
    return KIND_OF_TABLE.sub(lambda m: m[0] if m[1] != "email" else f"{{email {re.sub('[a-z]+', name, m[2])}}}", line)


def labelled_table(lines: list[str] | None = None) -> tuple[list[list[str]], list[list[int]]]:
    """Words and tags of the labelled table, or of some of its lines, and of lines like them."""
    words, tags = [], []
    chosen = TABLE.strip().split("\n") if lines is None else lines
    for line in [v for line in chosen for v in (line, *(_varied(line, n) for n in range(VARIANTS)))]:
        found, kinds, at = [], [], 0
        for m in [*KIND_OF_TABLE.finditer(line), None]:
            plain = line[at : m.start() if m else None].split()
            found += plain
            kinds += [0] * len(plain)
            if m:
                inside = m[2].split()
                found += inside
                kinds += [TAGS.index(m[1])] * len(inside)
                at = m.end()
        # Marks that stand right behind an entity belong to its last word, as in running text.
        joined, merged = [], []
        for word, tag in zip(found, kinds, strict=True):
            if joined and not tag and merged[-1] and set(word) <= set(EDGE):
                joined[-1] += word
            else:
                joined.append(word)
                merged.append(tag)
        words.append(joined)
        tags.append(merged)
    return words, tags


def train(texts: list[str]) -> Field:
    """A field from texts that the fixed forms label."""
    return train_on(*labelled(texts), views=(shape,))


def train_on(lines: list[list[str]], tags: list[list[int]], views: tuple = (shape, outline, digit_count)) -> Field:
    shapes: dict[str, int] = {}
    for words in lines:
        for word in words:
            for view in views:
                shapes.setdefault(view(word), len(shapes) + 2)
    field = Field(shapes, views)
    if lines:
        field.fit(lines, tags)
    else:
        field.weights[0][:, 0] = 1.0
    return field


def _added(text: str, line_at: int, words: list, tags: list[int], base: list) -> list[tuple[int, int, int]]:
    out, i = [], 0
    while i < len(words):
        j = i + 1
        while tags[i] and j < len(words) and tags[j] == tags[i]:
            j += 1
        if tags[i]:
            start, end = line_at + words[i].start(), line_at + words[j - 1].end()
            while start < end and text[start] in EDGE and text[start] != "(":
                start += 1
            while start < end and text[end - 1] in EDGE:
                end -= 1
            found = text[start:end]
            digits = _digits(found)
            enough = {1: bool(WRITTEN_AT.search(found)), 3: 13 <= len(digits) <= 19 and _luhn(digits), 4: 7 <= len(digits) <= 15}.get(tags[i], False)
            if enough and not any(a < end and start < b for _, a, b in base):
                out.append((len(KINDS) + tags[i] - 1, start, end))
        i = j
    return out


def _detect(field: Field):
    from hashlib import sha256

    import pyarrow as pa

    names = (*KINDS, *(f"crf_{k}" for k in KINDS))
    joined = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)

    def run(texts: list[str | None]) -> list:
        texts = [t or "" for t in texts]
        found = [base_spans(t) for t in texts]
        more: list[list] = [[] for _ in texts]
        where, lines = [], []
        for i, text in enumerate(texts):
            if not READ.search(text):
                continue
            at = 0
            for line in text.split("\n"):
                if READ.search(line):
                    words = list(TOKEN.finditer(line))
                    where.append((i, at, words))
                    lines.append([w[0] for w in words])
                at += len(line) + 1
        for (i, at, words), tags in zip(where, field.decode(lines, {}), strict=True):
            if any(tags):
                more[i] += _added(texts[i], at, words, tags, found[i])
        return [
            *[pa.array([sum(k == n for k, _, _ in f) for f in found], pa.int64()) for n in range(len(KINDS))],
            pa.array([sha256(joined(f).encode()).hexdigest() for f in found], pa.string()),
            pa.array([joined(f + sorted(m)) for f, m in zip(found, more, strict=True)], pa.string()),
            pa.array([len(m) for m in more], pa.int64()),
        ]

    return run


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: personal data in its whole text, by the fixed forms and by the random field.

    The field is trained on the labelled table above: national forms of telephone numbers, addresses written out, and
    numbers that are neither. It reads the lines that hold a digit, an @ or an address written out: its entities need one. Its spans
    (``crf_...``) are added where they overlap no fixed form; cards must pass the same test of their digits as those. Null and empty
    texts have no spans; repeated rows each get their row; an empty table gives none.
    """
    field = train_on(*labelled_table())
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = (
        f"doc_id {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
        + ", base_sha256 string, spans string, n_added bigint"
    )
    return arrow_map(narrow, "text", ["doc_id"], schema, _detect(field))
