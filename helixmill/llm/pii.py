"""Personal data: fixed detectors, and a character-level BiLSTM with CRF transitions.

The detectors find the base spans. The model is trained in numpy on the driver from labelled spans:
texts around the base spans of a bounded sample of documents (SAMPLE of those
with a digit or an '@', chosen by hash), with part of the spans rewritten
into forms that the detectors do not accept (spelled-out '@', phone numbers without
'+', dotted cards). Its labels are B and I of each kind and O; moves that no label
sequence can make are barred in the CRF.

A text is read whole: windows of WINDOW characters, one every HOP, cover all of it, and where two
cover a character their emissions are averaged, weighted toward each
window's middle. The best path over the whole text is then found exactly in two steps: a stretch of other labels
can beat O only if the emissions' lead over O, with the most that any move can
add, sums to a gain; characters in no such stretch are O, and one Viterbi path is decoded over each
run of the others, from O to O.

Added spans do not overlap base spans, which all stay.

Cases: a null or empty text has no spans; repeated rows give repeated results; an
empty table gives an empty result; without any sample to learn from only base
spans are found; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, hash_sample, table

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A lookbehind instead of a try at each digit of a run: a match never starts inside one.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"@|\((?:at|AT)\)")
_LETTER = re.compile(r"[A-Za-z]")

SAMPLE = 1500
#: Characters of a window read and of one learned from; places between windows; characters read at a time.
WINDOW, LEARNED, HOP, AT_ONCE = 384, 96, 336, 400_000
HIDDEN, STEPS, BATCH = 8, 160, 96


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed detectors, sorted."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((first, 0, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


# ---- the model


N_CHARS = 128
N_TAGS = 1 + 2 * len(KINDS)


def char_codes(text: str) -> np.ndarray:
    """ASCII as it is, other letters as 1 and the rest as 2."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.minimum(points, 127).astype(np.uint8)
    wide = np.flatnonzero(points > 127)
    seen, which = np.unique(points[wide], return_inverse=True)
    out[wide] = np.array([1 if chr(p).isalpha() else 2 for p in seen.tolist()], np.uint8)[which] if len(wide) else 0
    return out


def barred() -> np.ndarray:
    """-inf where a label cannot follow: I of a kind stands only after B or I of it."""
    out = np.zeros((N_TAGS, N_TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for tag in range(N_TAGS):
            if tag not in (inside - 1, inside):
                out[tag, inside] = -1e4
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Both directions are one batched product: axis 0 is the direction, and the second reads the window backwards."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"x": f(2, N_CHARS, 4 * hidden), "h": f(2, hidden, 4 * hidden), "o": f(2, hidden, N_TAGS), "c": np.zeros(N_TAGS, np.float32), "t": np.zeros((N_TAGS, N_TAGS), np.float32)}
        self.p["x"][:, :, hidden : 2 * hidden] += 0.5  # forget gates start open
        self.hidden = hidden

    def emissions(self, codes: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """(tags, windows, length) from character codes (windows, length); beyond a window's length its states stay zero.

        As states() below without what the gradients need: gates lie apart, and as sigmoid(x) = tanh(x / 2) / 2 + 1 / 2 one tanh does all four.
        """
        n, length = codes.shape
        d = self.hidden
        half = np.array([0.5, 0.5, 0.5, 1], np.float32)[None, :, None, None]
        table = self.p["x"].reshape(2, N_CHARS, 4, d).transpose(0, 2, 1, 3) * half
        weights = self.p["h"].reshape(2, d, 4, d).transpose(0, 2, 1, 3) * half
        h, c = np.zeros((2, n, d), np.float32), np.zeros((2, n, d), np.float32)
        x, z, more = np.empty((2, 4, n, d), np.float32), np.empty((2, 4, n, d), np.float32), np.empty((2, n, d), np.float32)
        states = np.empty((2, length, n, d), np.float32)
        by_time = np.ascontiguousarray(codes.T)
        short = lengths is not None and int(lengths.min()) < length
        for t in range(length):
            np.take(table[0], by_time[t], axis=1, out=x[0], mode="clip")
            np.take(table[1], by_time[length - 1 - t], axis=1, out=x[1], mode="clip")
            np.matmul(h[:, None], weights, out=z)
            z += x
            np.tanh(z, out=z)
            gates = z[:, :3]
            gates *= 0.5
            gates += 0.5
            c *= z[:, 1]
            np.multiply(z[:, 0], z[:, 3], out=more)
            c += more
            if short:
                c[0, lengths <= t] = 0
                c[1, lengths <= length - 1 - t] = 0
            np.tanh(c, out=h)
            h *= z[:, 2]
            states[0, t], states[1, length - 1 - t] = h[0], h[1]
        out = self.p["o"][0].T @ states[0].reshape(-1, d).T
        out += self.p["o"][1].T @ states[1].reshape(-1, d).T
        out += self.p["c"][:, None]
        return out.reshape(N_TAGS, length, n).transpose(0, 2, 1)

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(windows, length, tags): emissions as above, with the steps kept for the gradients."""
        n, length = codes.shape
        h, c = np.zeros((2, n, self.hidden), np.float32), np.zeros((2, n, self.hidden), np.float32)
        states = np.empty((2, length, n, self.hidden), np.float32)
        d = self.hidden
        for t in range(length):
            x = np.stack([self.p["x"][0, codes[:, t]], self.p["x"][1, codes[:, length - 1 - t]]])
            z = x + h @ self.p["h"]
            gates, g = sigmoid(z[..., : 3 * d]), np.tanh(z[..., 3 * d :])
            i, fg, o = gates[..., :d], gates[..., d : 2 * d], gates[..., 2 * d :]
            c_new = fg * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((h, c, i, fg, o, g, tc))
            c, h = c_new, o * tc
            states[:, t] = h
        if keep is not None:
            keep.append(states)
        both = states[0].transpose(1, 0, 2) @ self.p["o"][0] + states[1, ::-1].transpose(1, 0, 2) @ self.p["o"][1]
        return both + self.p["c"]

    def loss_and_grads(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        n, length = codes.shape
        keep: list = []
        e = self.states(codes, keep).astype(np.float64)
        move = self.p["t"].astype(np.float64) + barred()

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis)
            return m + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))

        alpha, beta = np.empty((length, n, N_TAGS)), np.zeros((length, n, N_TAGS))
        alpha[0] = e[:, 0]
        for t in range(1, length):
            alpha[t] = lse(alpha[t - 1][:, :, None] + move, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[t] = lse(move + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = lse(alpha[-1], 1)
        gold = np.take_along_axis(e, tags[:, :, None], 2)[..., 0].sum(1) + move[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(alpha + beta - log_z[None, :, None]).transpose(1, 0, 2)
        np.put_along_axis(de, tags[:, :, None], np.take_along_axis(de, tags[:, :, None], 2) - 1, 2)
        dt = np.zeros((N_TAGS, N_TAGS))
        for t in range(1, length):
            dt += np.exp(alpha[t - 1][:, :, None] + move + (e[:, t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(0)
        np.add.at(dt, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        scale = 1.0 / n
        de, dt = (de * scale).astype(np.float32), (dt * scale).astype(np.float32)
        states = keep.pop()
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["t"], grads["c"] = dt, de.sum((0, 1))
        by_time = de.transpose(1, 0, 2)
        grads["o"][0] = np.einsum("tnh,tnk->hk", states[0], by_time)
        grads["o"][1] = np.einsum("tnh,tnk->hk", states[1, ::-1], by_time)
        out = np.stack([by_time @ self.p["o"][0].T, (by_time @ self.p["o"][1].T)[::-1]])
        dh, dc, d = np.zeros((2, n, self.hidden), np.float32), np.zeros((2, n, self.hidden), np.float32), self.hidden
        for t in range(length - 1, -1, -1):
            h, c, i, fg, o, g, tc = keep[t]
            dh = dh + out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - g * g)], -1)
            grads["h"] += h.transpose(0, 2, 1) @ dz
            np.add.at(grads["x"][0], codes[:, t], dz[0])
            np.add.at(grads["x"][1], codes[:, length - 1 - t], dz[1])
            dh, dc = dz @ self.p["h"].transpose(0, 2, 1), dc * fg
        return float((log_z - gold).mean()), grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.03, seed: int = 3) -> Tagger:
        """Adam over random batches; the same result for the same input."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = r.integers(0, len(codes), min(batch, len(codes)))
            _, grads = self.loss_and_grads(codes[pick], tags[pick])
            norm = max(1.0, float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values()))) / 5)
            pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g / norm
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def paths(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi over (chains, length, tags); beyond a chain's length its tags are O."""
        n, length, _ = e.shape
        move = self.p["t"] + barred().astype(np.float32)
        start = np.array([-1e4 if t and t % 2 == 0 else 0 for t in range(N_TAGS)], np.float32)
        score, back = e[:, 0] + start, np.zeros((length, n, N_TAGS), np.int8)
        for t in range(1, length):
            through = score[:, :, None] + move
            back[t] = through.argmax(1)
            nxt = through.max(1) + e[:, t]
            live = (t < lengths)[:, None]
            score = np.where(live, nxt, score)
            back[t] = np.where(live, back[t], np.arange(N_TAGS, dtype=np.int8))
        tags = np.zeros((n, length), np.int8)
        tag = score.argmax(1)
        for t in range(length - 1, -1, -1):
            tags[:, t] = tag
            tag = back[t][np.arange(n), tag]
        tags[np.arange(length)[None, :] >= lengths[:, None]] = 0
        return tags


def read(tagger: Tagger, codes: np.ndarray, pieces: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Emissions (tags, characters) of all characters of the pieces, one after the other.

    A piece (first, last, a, b) is the part from a to b of a text whose codes stand from first to last. A text's windows
    begin at every HOP, wherever its pieces do, so that a character's emissions do not depend on the pieces.
    """
    sizes = np.array([b - a for _, _, a, b in pieces])
    put = np.cumsum(sizes) - sizes
    rows = []  # window's first place in codes, its length, and the place of its first character in the output, which may lie before the piece
    for k, (first, last, a, b) in enumerate(pieces):
        n = last - first
        at = np.arange(max(0, (a - WINDOW) // HOP + 1), -(-b // HOP)) * HOP
        at = at[(at < n) & ((at == 0) | (at + WINDOW - HOP < n))]  # the last window that ends the text is the last one
        rows.append(np.stack([at + first, np.minimum(WINDOW, n - at), put[k] + at - a, np.full(len(at), put[k]), np.full(len(at), put[k] + b - a)], 1))
    rows = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
    total, weight = np.zeros((N_TAGS, int(sizes.sum())), np.float32), np.zeros(int(sizes.sum()), np.float32)
    rows = rows[np.argsort(rows[:, 1], kind="stable")]
    for some in np.array_split(rows, max(1, -(-len(rows) // 1024))):
        if not len(some):
            continue
        place = np.arange(int(some[-1, 1]))
        window = np.where(place < some[:, 1:2], codes[np.minimum(some[:, :1] + place, len(codes) - 1)], 32)
        e = tagger.emissions(window, some[:, 1])
        for row, (_, n, to, least, end) in enumerate(some.tolist()):
            w = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)).astype(np.float32) if n < WINDOW else _MIDDLE
            a, b = max(least - to, 0), min(end - to, n)
            total[:, to + a : to + b] += e[:, row, a:b] * w[a:b]
            weight[to + a : to + b] += w[a:b]
    total /= np.maximum(weight, 1)
    return total


_MIDDLE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def open_runs(lead: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Runs of places in some stretch whose leads sum to more than -most."""
    total = np.concatenate([[0.0], np.cumsum(lead, dtype=np.float64)])
    ends = total[1:] - np.minimum.accumulate(total[:-1])  # the best stretch that ends here
    starts = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]  # and that starts here
    held = np.concatenate([[False], ends + starts - lead > -most - 1e-3, [False]])
    edge = np.flatnonzero(held[1:] != held[:-1])
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def decode(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The model's spans of each text: (start, kind number, end).

    Emissions of texts up to AT_ONCE characters are held while they are decoded. Of a longer text only the leads are, and
    its runs are read again: some 30 bytes a character.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    move = (tagger.p["t"] + barred()).astype(np.float32)
    apart = move.copy()
    apart[0, 0] = -np.inf
    most = max(0.0, float(apart.max() - move[0, 0]))
    sizes = np.array([len(t) for t in texts])

    def leads(e: np.ndarray) -> np.ndarray:
        return e[1:].max(0) - e[0] + most

    def solve(e: np.ndarray, runs: list[tuple[int, int, int, int]]) -> None:
        """Runs (text, first, last, place of the first in e): from O before each and to O behind it, but for the text's ends."""
        for group in grouped(sorted(runs, key=lambda r: r[2] - r[1]), lambda r: r[2] - r[1]):
            k, first, last, place = np.array(group).T
            lengths = last - first
            step = np.arange(int(lengths.max()))
            inside = step < lengths[:, None]
            rows = np.where(inside, e[:, np.where(inside, place[:, None] + step, 0)], 0).transpose(1, 2, 0)
            rows[:, 0] += np.where(first > 0, 1, 0)[:, None] * move[0]
            rows[np.arange(len(group)), lengths - 1] += np.where(last < sizes[k], 1, 0)[:, None] * move[:, 0]
            tags = tagger.paths(rows, lengths)
            for row in np.flatnonzero(tags.any(1)):
                i, marks = 0, np.flatnonzero(tags[row])
                while i < len(marks):
                    j, kind = i, (int(tags[row, marks[i]]) - 1) // 2
                    while j + 1 < len(marks) and marks[j + 1] == marks[j] + 1 and tags[row, marks[j + 1]] == 2 + 2 * kind:
                        j += 1
                    out[k[row]].append((int(first[row] + marks[i]), kind, int(first[row] + marks[j]) + 1))
                    i = j + 1

    for names in grouped([k for k, t in enumerate(texts) if 0 < len(t) <= AT_ONCE], lambda k: len(texts[k]), even=False):
        ends = np.cumsum([len(texts[k]) for k in names]).tolist()
        pieces = [(end - len(texts[k]), end, 0, len(texts[k])) for k, end in zip(names, ends, strict=True)]
        e = read(tagger, np.concatenate([char_codes(texts[k]) for k in names]), pieces)
        lead = leads(e)
        solve(e, [(k, a, b, f + a) for k, (f, end, _, _) in zip(names, pieces, strict=True) for a, b in open_runs(lead[f:end], most)])
    for k in (k for k, t in enumerate(texts) if len(t) > AT_ONCE):
        codes = char_codes(texts[k])
        n = len(codes)
        lead = np.concatenate([leads(read(tagger, codes, [(0, n, a, min(a + AT_ONCE, n))])) for a in range(0, n, AT_ONCE)])
        for group in grouped(open_runs(lead, most), lambda r: r[1] - r[0] + WINDOW, even=False):
            e, cuts = read(tagger, codes, [(0, n, a, b) for a, b in group]), np.cumsum([0] + [b - a for a, b in group])
            solve(e, [(k, a, b, cuts[i]) for i, (a, b) in enumerate(group)])
    return [sorted(o) for o in out]


def grouped(items: list, size: Callable[[object], int], even: bool = True) -> Iterator[list]:
    """The items in order, about AT_ONCE in size at a time; with `even`, where each counts as much as the largest of its group, at most twice the first."""
    held, total, largest = [], 0, 0
    for x in items:
        n = size(x)
        if held and (((len(held) + 1) * max(largest, n) if even else total + n) > AT_ONCE or (even and n > 2 * size(held[0]))):
            yield held
            held, total, largest = [], 0, 0
        held.append(x)
        total, largest = total + n, max(largest, n)
    if held:
        yield held


# ---- labelled spans to learn from


def variant(text: str, kind: int, r: np.random.Generator) -> str:
    """A span's text in a form that the detectors may not know."""
    choice = int(r.integers(0, 3))
    if kind == 0:
        return [text, text.replace("@", " (at) "), text.replace("@", "(at)")][choice]
    if kind == 2:
        digits = re.sub("[^0-9]", "", text)
        return [text, ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), text][choice]
    if kind == 3:
        digits = re.sub("[^0-9]", "", text)
        return [text, f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", text][choice]
    return text


def examples(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags, from texts with base spans; some spans rewritten, and plain numbers as O."""
    r = np.random.default_rng(seed)
    codes, tags = [], []
    for text in texts:
        spans = base_spans(text)
        # A window of the text without a span: prose and its own numbers.
        at = int(r.integers(0, max(1, len(text) - LEARNED)))
        if not any(a < at + LEARNED and at < b for a, _, b in spans):
            codes.append(char_codes(text[at : at + LEARNED].ljust(LEARNED)))
            tags.append(np.zeros(LEARNED, np.int64))
        for start, kind, end in spans:
            before, after = text[max(0, start - 60) : start], text[end : end + 60]
            if re.search("[0-9@+]", before + after):
                before, after = re.sub("[0-9@+]", "", before), re.sub("[0-9@+]", "", after)
            said = variant(text[start:end], kind, r)
            put = int(r.integers(0, 56))
            before = before[max(0, len(before) - put) :]
            line = (before + said + after)[:LEARNED].ljust(LEARNED)
            row = np.zeros(LEARNED, np.int64)
            last = min(LEARNED, len(before) + len(said))
            row[len(before) : last] = 2 + 2 * kind
            row[len(before)] = 1 + 2 * kind
            codes.append(char_codes(line))
            tags.append(row)
            # The same place with a number that is no personal data.
            number = str(int(r.integers(1, 10 ** int(r.integers(1, 9)))))
            form = int(r.integers(0, 4))
            if form == 0:
                number = f"{number[:2]}.{number[2:4] or 0}"
            elif form == 1:
                number = r.bytes(int(r.integers(4, 24))).hex()
            codes.append(char_codes((before + number + after)[:LEARNED].ljust(LEARNED)))
            tags.append(np.zeros(LEARNED, np.int64))
    return (np.stack(codes), np.stack(tags)) if codes else (np.zeros((0, LEARNED), np.int64), np.zeros((0, LEARNED), np.int64))


def learned(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger fitted on at most `sample` texts of 800 characters around a sign, or None without spans."""
    signs = docs.where(F.col("text").rlike("[0-9@]")).select(F.expr("substring(text, greatest(1, regexp_instr(text, '[0-9@]') - 200), 800)").alias("text"))
    codes, tags = examples(hash_sample(signs, "text", sample))
    return Tagger().fit(codes, tags) if len(codes) else None


# ---- the operator


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, text string"


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def with_added(text: str, base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and what the model adds beside them: whole tokens, no letters in numbers, and a sign of '@' in addresses."""
    edge = lambda m: text[max(0, m[0] - 1) : m[0]].isalnum() or text[m[2] : m[2] + 1].isalnum()
    fits = lambda m: m[2] - m[0] >= 7 and not edge(m) and bool(_AT.search(text, m[0], m[2]) if m[1] == 0 else not _LETTER.search(text, m[0], m[2]))
    return sorted(base + [m for m in more if fits(m) and not any(m[0] < b and a < m[2] for a, _, b in base)])


def personal_data(docs: DataFrame, tagger: Tagger | None, mask: bool = True) -> DataFrame:
    """Spans of every whole text, and with `mask` the text with all of them masked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            more = decode(tagger, texts) if tagger else [[] for _ in texts]
            rows = []
            for text, added in zip(texts, more, strict=True):
                base = base_spans(text)
                spans = with_added(text, base, added)
                n = [sum(s[1] == kind for s in base) for kind in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(spans), masked(text, spans) if mask else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 3, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def masked_documents(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with all spans masked in text, and n_chars counted anew; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            texts = batch.column("text").to_pylist()
            more = decode(tagger, [t or "" for t in texts]) if tagger else [[] for _ in texts]
            for k, added in enumerate(more):
                if texts[k]:
                    texts[k] = masked(texts[k], with_added(texts[k], base_spans(texts[k]), added))
            cols = {name: batch.column(name) for name in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, learned(docs), mask=False).drop("text")
