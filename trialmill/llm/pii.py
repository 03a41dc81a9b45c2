"""Personal data: exact base patterns, and a linear-chain conditional random field that adds spans.

The field works on word-shape features, is trained from a small labelled table on the driver, and reads every token of
every text. Tokens, shapes and Viterbi paths are numpy arrays over batches of texts: a text is cut into blocks, the best
path between any two labels at a block's ends is found for all blocks at once, and a scan over the blocks joins them, so
that paths are exact and memory doesn't grow with the labels of a long text.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, id_text, table

#: The kinds, in the order of the contract; label 0 of the field is "none".
KINDS = ("email", "ip", "card", "phone")
#: Characters of one numpy step, tokens of a Viterbi block, blocks that are decoded at once.
STEP, BLOCK, GROUP = 1 << 19, 64, 2048
#: Words that the field tells apart by themselves.
LEXICON = ("at", "dot", "com", "org", "net", "tel", "phone", "call", "fax", "mobile", "card", "visa", "number", "ip", "host", "address", "mail", "email", "version", "section", "page", "isbn", "order", "token")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Inside a run of digits no later start can match where the run's first digit doesn't; it is not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: A run of letters, of digits or of characters beyond ASCII, or one sign.
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\x00-\x7f]+|[!-~]")
_LEXICON_KEYS = np.array(sorted((int.from_bytes(w.encode(), "little"), w) for w in LEXICON), dtype=object)
_CLASS = np.zeros(129, dtype=np.uint8)  # 0: white space and controls, 1: letter, 2: digit, 3: sign, 4: beyond ASCII
_CLASS[33:127], _CLASS[48:58], _CLASS[128] = 3, 2, 4
_CLASS[[*range(65, 91), *range(97, 123)]] = 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping for each kind; failing matches are dropped."""
    spans: list[tuple[int, int, str]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            spans.append((start, domain.end(), "email"))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        spans += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
        if "+" in text:
            spans += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    if word[0].isdigit():
        return f"d{len(word)}" if len(word) < 5 else "d5-12" if len(word) < 13 else "d13+" + ("luhn" if len(word) < 20 and luhn(word) else "")
    if word[0] > "\x7f":
        return "?"
    low = word.lower()
    if low in LEXICON:
        return low
    if word[0].isalpha():
        return ("X" if word.isupper() else "Xx" if word[0].isupper() else "x") + ("" if len(word) > 2 else "2")
    return word if word in "+-().@:/=#[]" else "?"


def narrow(text: str) -> np.ndarray:
    """A byte for each code point; 128 stands for all beyond ASCII."""
    parts = [np.minimum(np.frombuffer(text[i : i + STEP].encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128).astype(np.uint8) for i in range(0, len(text), STEP)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint8)


def tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, class) of the tokens of a narrow text."""
    kind = _CLASS[raw]
    new = np.ones(len(raw), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    edge = np.append(np.flatnonzero(new), len(raw))
    start, end = edge[:-1], edge[1:]
    held = kind[start] > 0
    return start[held], end[held], kind[start[held]]


#: Every shape; a token after white space has its shape behind a blank.
SHAPES = ("?", *LEXICON, "x", "x2", "Xx", "Xx2", "X", "X2", "d1", "d2", "d3", "d4", "d5-12", "d13+", "d13+luhn", *"+-().@:/=#[]")
_PLACE = {s: i for i, s in enumerate(SHAPES)}


def shape_places(raw: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where in SHAPES the shape of every token stands."""
    size, first = end - start, raw[start]
    out = np.zeros(len(start), dtype=np.int32)  # beyond ASCII: the first
    signs = np.array([_PLACE[shape(chr(c))] if c > 32 else 0 for c in range(128)], dtype=np.int32)
    out[kind == 3] = signs[first[kind == 3]]
    digit = kind == 2
    lengths = np.array([0, *(_PLACE[shape("0" * n)] for n in range(1, 13))], dtype=np.int32)
    out[digit] = lengths[np.minimum(size[digit], 12)]
    for i in np.flatnonzero(digit & (size > 12)):
        out[i] = _PLACE[shape(raw[start[i] : min(end[i], start[i] + 20)].tobytes().decode())]
    word = np.flatnonzero(kind == 1)
    ups = np.concatenate(([0], np.cumsum(raw < 91, dtype=np.int64)))  # inside a run of letters only capitals lie below 91
    capital = ups[end[word]] - ups[start[word]]
    form = np.where(capital == size[word], 2, np.where(first[word] < 91, 1, 0)) * 2 + (size[word] <= 2)
    out[word] = np.array([_PLACE[s] for s in ("x", "x2", "Xx", "Xx2", "X", "X2")], dtype=np.int32)[form]
    short = word[size[word] <= 8]
    key = np.zeros(len(short), dtype=np.uint64)
    for i in range(8):
        live = size[short] > i
        key[live] |= (raw[start[short[live]] + i] | 32).astype(np.uint64) << np.uint64(8 * i)
    known = _LEXICON_KEYS[:, 0].astype(np.uint64)
    where = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hit = known[where] == key
    out[short[hit]] = np.array([_PLACE[w] for w in _LEXICON_KEYS[:, 1]], dtype=np.int32)[where[hit]]
    return out


def text_shapes(text: str) -> list[str]:
    """The shapes of a text's tokens, a blank before those that come after white space."""
    found = list(_TOKEN.finditer(text))
    return [" " * (i == 0 or found[i - 1].end() < m.start()) + shape(m[0]) for i, m in enumerate(found)]


#: A token's features: the shapes of a token and its neighbours, up to three away.
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
PAD = max(OFFSETS)


class Field:
    """Weights of a linear-chain conditional random field over shapes."""

    def __init__(self, sentences: list[tuple[list[str], list[int]]], epochs: int = 12, rate: float = 0.3):
        self.k = len(KINDS) + 1
        kinds = sorted({s for shapes, _ in sentences for s in shapes})
        self.at = {s: i + 1 for i, s in enumerate(kinds)}  # 0: beyond the ends or unseen
        self.emit = np.zeros((len(OFFSETS), len(kinds) + 1, self.k))
        self.step = np.zeros((self.k, self.k))
        data = [(self.codes(shapes), np.asarray(labels)) for shapes, labels in sentences]
        squares = [np.full_like(self.emit, 1e-6), np.full_like(self.step, 1e-6)]
        rng = np.random.default_rng(1)
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                for w, g, s in zip((self.emit, self.step), self.gradient(*data[i]), squares, strict=True):
                    g -= 1e-4 * w
                    s += g * g
                    w += rate * g / np.sqrt(s)

    def codes(self, shapes: list[str]) -> np.ndarray:
        pad = [0] * PAD + [self.at.get(s, 0) for s in shapes] + [0] * PAD
        return np.stack([pad[PAD + o : PAD + o + len(shapes)] for o in OFFSETS], axis=1)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.emit[o][codes[:, o]] for o in range(len(OFFSETS)))

    def gradient(self, codes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts, by forward and backward sums."""
        e, n = self.scores(codes), len(labels)
        add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        ahead, back = np.zeros((n, self.k)), np.zeros((n, self.k))
        ahead[0] = e[0]
        for t in range(1, n):
            ahead[t] = e[t] + add(ahead[t - 1][:, None] + self.step, 0)
        for t in range(n - 2, -1, -1):
            back[t] = add(self.step + (e[t + 1] + back[t + 1])[None, :], 1)
        total = add(ahead[-1], 0)
        share = np.eye(self.k)[labels] - np.exp(ahead + back - total)
        emit, step = np.zeros_like(self.emit), np.zeros_like(self.step)
        for o in range(len(OFFSETS)):
            np.add.at(emit[o], codes[:, o], share)
        for t in range(1, n):
            step -= np.exp(ahead[t - 1][:, None] + self.step + (e[t] + back[t])[None, :] - total)
            step[labels[t - 1], labels[t]] += 1
        return emit, step

    def paths(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of texts that lie end to end; first: where each text's tokens begin, then their number.

        codes has PAD zeros before and after each text's shapes, so text i begins at first[i] + PAD (2 i + 1).
        """
        k, sizes = self.k, np.diff(first)
        out = np.zeros(int(first[-1]), dtype=np.uint8)
        per = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), per)
        head = np.concatenate(([0], np.cumsum(per)))
        begin = first[owner] + (np.arange(len(owner)) - head[owner]) * BLOCK
        length = np.minimum(first[owner + 1] - begin, BLOCK)

        groups = [np.arange(i, min(i + GROUP, len(owner))) for i in range(0, len(owner), GROUP)]
        groups = [g[np.argsort(-length[g], kind="stable")] for g in groups]  # blocks that still run stand first
        weights = [np.ascontiguousarray(w.T) for w in self.emit]

        def scores(t: int, g: np.ndarray) -> np.ndarray:
            live = int(np.searchsorted(-length[g], -t, side="left"))
            place = begin[g[:live]] + t + PAD * (2 * owner[g[:live]] + 1)
            return sum(w[:, codes[place + o]] for w, o in zip(weights, OFFSETS, strict=True))

        # For each block the best way from the label before it to the label at its end.
        ways = np.empty((len(owner), k, k))
        for g in groups:
            opening = begin[g] == first[owner[g]]  # a text's first block has no label before it
            best = np.where(opening, 0, self.step[:, :, None]) + scores(0, g)
            for t in range(1, int(length[g[0]])):
                e = scores(t, g)
                now = best[:, :, : e.shape[1]]
                most = now[:, 0, None] + self.step[0][:, None]
                for x in range(1, k):
                    np.maximum(most, now[:, x, None] + self.step[x][:, None], out=most)
                best[:, :, : e.shape[1]] = most + e
            ways[g] = best.transpose(2, 0, 1)
        # Along the blocks of each text, then back.
        came, ahead = np.zeros((len(owner), k), dtype=np.uint8), np.zeros(k)
        ends = np.zeros(len(owner), dtype=np.uint8)
        begins = np.zeros(len(owner), dtype=np.uint8)
        for text in np.flatnonzero(per):
            a, z = int(head[text]), int(head[text + 1])
            ahead = ways[a][0]
            for x in range(a + 1, z):
                both = ahead[:, None] + ways[x]
                came[x] = both.argmax(axis=0)
                ahead = both.max(axis=0)
            label = int(ahead.argmax())
            for x in range(z - 1, a - 1, -1):
                ends[x] = label
                label = int(came[x][label])
                begins[x] = label
        # Inside each block between the labels that are now known.
        for g in groups:
            back = np.zeros((int(length[g[0]]), k, len(g)), dtype=np.uint8)
            best = np.where(begin[g] == first[owner[g]], 0, self.step[begins[g]].T) + scores(0, g)
            for t in range(1, len(back)):
                e = scores(t, g)
                now = best[:, : e.shape[1]]
                both = now[:, None] + self.step[:, :, None]
                back[t, :, : e.shape[1]] = both.argmax(axis=0)
                best[:, : e.shape[1]] = both.max(axis=0) + e
            label = ends[g].copy()
            for t in range(len(back) - 1, -1, -1):
                live = int(np.searchsorted(-length[g], -t, side="left"))
                out[begin[g[:live]] + t] = label[:live]
                label[:live] = back[t, label[:live], np.arange(live)]
        return out

    def decode(self, batch: list[list[str]]) -> list[np.ndarray]:
        """The best labels of lists of shapes."""
        codes = [x for shapes in batch for x in (*[0] * PAD, *(self.at.get(s, 0) for s in shapes), *[0] * PAD)]
        first = np.concatenate(([0], np.cumsum([len(b) for b in batch]))).astype(np.int64)
        labels = self.paths(np.array(codes, dtype=np.int32), first)
        return [labels[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]


def labelled_table(seed: int = 9, each: int = 24) -> list[list[tuple[str, str]]]:
    """Sentences as lists of (part, kind or ""): a small labelled table made by rule."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    some = lambda *of: rng.choice(of)
    word = lambda: "".join(some("an", "er", "th", "on", "de", "is", "ou", "é", "ß", "lo", "st") for _ in range(rng.randint(1, 4)))
    name, site = lambda: some("jo", "ann", "maria", "sven", "lee", "info", "Petra", word()), lambda: some("example", "mail", "post", "acme", "firm")
    byte = lambda: str(rng.randint(0, 255))

    def prose(low: int, high: int) -> str:
        words = []
        for _ in range(rng.randint(low, high)):
            w = some(word(), word(), word(), word(), word(), "at", "dot", "phone", "number", "order", "page", "at the", num(rng.randint(1, 5)), "(" + word() + ")")
            words.append((w.capitalize() if rng.random() < 0.25 else w) + some("", "", "", "", ".", ",", ":", "\n"))
        return " ".join(words)

    def luhn_card() -> str:
        body = num(15)
        return next(body + d for d in "0123456789" if luhn(body + d))

    rows = []
    for _ in range(each):
        card = luhn_card()
        quads = [card[i : i + 4] for i in range(0, 16, 4)]
        tail = lambda: some(". ", ", ", " ", "; ", "\n") + some(prose(1, 8), prose(2, 8), prose(0, 1))
        lead = lambda *cues: some(prose(1, 6), prose(1, 6), "", word(), word()) + " " + some("", *cues)
        call, mail = ("call ", "phone ", "tel: ", "mobile ", "fax ", "number: "), ("write ", "mail ", "email: ", "address ")
        found = [
            (call, f"({num(3)}) {num(3)}-{num(4)}", "phone"),
            (call, f"{num(3)}-{num(3)}-{num(4)}", "phone"),
            (call, f"{num(3)}.{num(3)}.{num(4)}", "phone"),
            (call, f"+{num(2)} {num(3)} {num(3)} {num(4)}", "phone"),
            (call, f"+1 ({num(3)}) {num(3)}-{num(4)}", "phone"),
            (mail, f"{name()} at {site()} dot {some('com', 'org', 'net')}", "email"),
            (mail, f"{name()} (at) {site()} (dot) {some('com', 'org', 'net')}", "email"),
            (mail, f"{name()} [at] {site()} [dot] {some('com', 'org', 'net')}", "email"),
            (mail, f"{name()}.{name()}@{site()}.{some('com', 'org', 'net')}", "email"),
            (("host ", "ip "), ".".join(byte() for _ in range(4)), "ip"),
            (("host ", "ip "), " . ".join(byte() for _ in range(4)), "ip"),
            (("card ", "visa ", "card number: "), " ".join(quads), "card"),
            (("card ", "visa ", "card number: "), ".".join(quads), "card"),
            (("card ", "visa "), card, "card"),
        ]
        rows += [[(lead(*cues), ""), (text, kind), (tail(), "")] for cues, text, kind in found]
        nothing = [
            some("version ", "section ", "page ", "see ") + f"{num(1)}.{num(2)}.{num(1)}",
            f"on 20{num(2)}-{num(2)}-{num(2)} at {num(2)}:{num(2)}",
            f"the {num(3)}{name()}{num(2)}{name()}{num(4)} token",
            f"order {num(16)} of the {num(2)}",
            f"ISBN {num(3)}-{num(1)}-{num(3)}-{num(5)}-{num(1)}",
            f"in {num(4)} the {num(3)} of {num(2)}, {num(1)} and {num(5)}",
            f"it is at the end of {site()} to {num(2)} %",
            f'token = "{num(2)}be{num(5)}e{num(2)}c{num(1)}a{num(3)}"',
            f"{num(16)}### that*** de&&& {num(14)}%%%",
            f"{word()}.{word()} {word()}: {word()}-{word()}/{word()} ({num(4)})",
            f"https://www.{site()}.com/{word()}/{num(4)}?{word()}={num(3)}",
            f"{word()}. " * rng.randint(2, 6),
            f"{some(word(), 'at', 'dot', 'At')} " * rng.randint(8, 30) + f"{word()} " * rng.randint(0, 20),
            f'{some("token = ", "key: ", "")}"' + "".join(some(*"0123456789abcdef") for _ in range(40)) + '"',
            f"{num(16)} {num(16)}",
            f"{num(1)}. {num(2)}. {num(3)}. {num(2)}, {num(4)}-{num(4)}, {num(2)}-{num(2)}",
        ]
        rows += [[(prose(0, 5) + " " + n + " " + prose(0, 5), "")] for n in nothing] + [[(prose(8, 20), "")] for _ in range(5)]
    return rows


def sentence(parts: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """(text, spans) of a labelled row."""
    text, spans = "", []
    for part, kind in parts:
        if kind:
            spans.append((len(text), len(text) + len(part), kind))
        text += part
    return text, spans


@functools.cache
def trained(seed: int = 9) -> Field:
    sentences = []
    for text, spans in map(sentence, labelled_table(seed)):
        inside = lambda m: next((KINDS.index(k) + 1 for a, z, k in spans if a <= m.start() < z), 0)  # noqa: B023, E731
        sentences.append((text_shapes(text), list(map(inside, _TOKEN.finditer(text)))))
    return Field(sentences)


def added_spans(field: Field, texts: list[str], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """Spans that the field's labels make beside the base spans of each text; none of them touches a base span."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]

    @functools.lru_cache(maxsize=1)
    def reach(k: int) -> tuple[list[int], list[int]]:
        """The starts of a text's base spans in order, and the farthest end of any up to each."""
        spans = sorted(base[k])
        return [s for s, _, _ in spans], list(itertools.accumulate((e for _, e, _ in spans), max))

    for i, j in chunks(texts, STEP):
        lengths = np.fromiter((len(t) + 1 for t in texts[i:j]), dtype=np.int64, count=j - i)
        text_at = np.concatenate(([0], np.cumsum(lengths)))
        raw = narrow("\n".join(texts[i:j]))
        start, end, kind = tokens(raw)
        first = np.searchsorted(start, text_at)
        own = np.repeat(np.arange(j - i), np.diff(first))
        codes = np.zeros(len(start) + 2 * PAD * (j - i), dtype=np.int32)
        apart = np.ones(len(start), dtype=np.int64)
        apart[1:] = start[1:] > end[:-1]
        place = np.array([[field.at.get(blank + s, 0) for s in SHAPES] for blank in ("", " ")], dtype=np.int32)
        codes[np.arange(len(start)) + PAD * (2 * own + 1)] = place[apart, shape_places(raw, start, end, kind)]
        labels = field.paths(codes, first)
        new = np.ones(len(labels), dtype=bool)
        new[1:] = (labels[1:] != labels[:-1]) | (own[1:] != own[:-1])
        edge = np.append(np.flatnonzero(new), len(labels))
        for r in np.flatnonzero(labels[edge[:-1]]):
            x, y = edge[r], edge[r + 1]
            shift, held = int(text_at[own[x]]), i + int(own[x])
            a, z = int(start[x]) - shift, int(end[y - 1]) - shift
            starts, farthest = reach(held)
            before = bisect_left(starts, z)  # base spans that begin before this one ends; does one of them end behind its start?
            if not before or farthest[before - 1] <= a:
                out[held].append((a, z, KINDS[labels[x] - 1]))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, base, added): lists of (start, end, kind) in code points, end exclusive, for each row of docs.

    Null texts count as empty and have no spans; rows that repeat get a row each; null ids stay null; other columns are
    ignored; an empty table gives an empty result. Base spans of different kinds may overlap; added ones touch no base span.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or trained())  # a few thousand weights

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            base = [base_spans(t) for t in texts]
            as_rows = lambda s: [{"start": a, "end": z, "kind": k} for a, z, k in s]
            added = added_spans(held.value, texts, base)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "base": list(map(as_rows, base)), "added": list(map(as_rows, added))})

    span = "array<struct<start: int, end: int, kind: string>>"
    return id_text(docs).mapInPandas(each, f"doc_id long, base {span}, added {span}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are over the base spans; spans also has the added ones, n_added counts them."""
    found = find(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.array_sort(keyed)).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op5_pii": op5_pii}
ORACLE: dict[str, str] = {}
