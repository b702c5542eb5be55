"""Personal data: exact patterns, and a semi-Markov conditional random field for the rest.

Four base patterns find e-mail addresses, IP addresses, card and phone numbers as
they are usually written. Disguised or unusual forms ("name at host dot com", a
phone number without its plus, an access token) become candidate segments, numbers
with every way to begin and end at a group of digits; the field scores each
with features of the whole span and its surroundings, and dynamic programming over
segments of at most ``LONGEST`` characters chooses boundaries and types together.
Base spans are fixed: candidates that touch one are left out. The field is trained
in numpy by maximum likelihood on sentences made from a seed, so it is the same for
every input; it never depends on the documents that it reads.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, texts_of

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart; a secret is a token, key or password that has no base pattern.
FIELD_KINDS = (*KINDS, "secret")
LONGEST = 96
SEED, SENTENCES, EPOCHS, RATE, PENALTY = 3, 900, 14, 0.3, 1e-3

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = [int(c) for c in digits[::-2]], [2 * int(c) for c in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns by kind, then start; linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > end and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append(("email", left, end := m.end()))
        else:
            end = max(end, left if left == at else end)
        at = text.find("@", max(at + 1, end))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?| (?:at|AT) | @ ?|@ ")
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?| (?:dot|DOT) )[A-Za-z0-9-]+)+")
SPELT_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?| dot |\.)[0-9]{1,3}){3}(?![0-9])")
NUMBER = re.compile(r"(?<![0-9])(?:\(|\b00)?[0-9][0-9 ().\-/–]{5,94}[0-9](?![0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,64}[0-9])[A-Za-z0-9_+/-]{16,94}={0,2}(?![A-Za-z0-9_+/=-])")
#: No number of a kind has more digits, or more groups of them.
MOST_DIGITS, MOST_GROUPS = 19, 8
WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,4}\Z")

#: Words before a value that tell what it is, in English, French, German and Spanish.
CUES = {
    "email": {"email", "mail", "contact", "write", "reach", "address", "courriel", "adresse", "correo", "escribe", "kontakt", "schreiben"},
    "phone": {"tel", "phone", "call", "mobile", "fax", "telephone", "ring", "dial", "whatsapp", "sms", "téléphone", "appelez", "portable", "telefon", "anruf", "handy", "teléfono", "llame", "móvil"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "pay", "amex", "carte", "karte", "kreditkarte", "tarjeta"},
    "ip": {"ip", "host", "server", "login", "router", "from", "serveur", "servidor"},
    "secret": {"token", "secret", "key", "apikey", "password", "passwd", "pwd", "bearer", "auth", "credential", "clé", "jeton", "schlüssel", "passwort", "clave", "contraseña"},
    "other": {"order", "invoice", "isbn", "version", "id", "no", "nr", "ref", "serial", "page", "part", "build", "date", "on", "commit", "md5", "sha", "checksum", "file", "facture", "rechnung", "factura"},
}
CUE_OF = {w: kind for kind, words in CUES.items() for w in words}


def candidates(text: str) -> list[tuple[int, int]]:
    """Segments that may be personal data in an unusual form, at most LONGEST long."""
    found: set[tuple[int, int]] = set()
    if "at" in text or "AT" in text or "@" in text:
        for m in AT.finditer(text):
            left = LOCAL_END.search(text, max(0, m.start() - LONGEST), m.start())
            if left and (right := SPELT_DOMAIN.match(text, m.end(), left.start() + LONGEST)):
                found.add((left.start(), right.end()))
    found |= {m.span() for m in SPELT_IP.finditer(text)}
    for m in NUMBER.finditer(text):
        groups = [g.span() for g in re.finditer(r"[0-9]+", m[0])]
        for k, (a, _) in enumerate(groups):
            a = m.start() if not k else m.start() + a - (m[0][a - 1] == "(")
            n = 0
            for x, y in groups[k : k + MOST_GROUPS]:
                n += y - x
                if n > MOST_DIGITS:
                    break
                if n >= 7:
                    found.add((a, m.start() + y))
    found |= {m.span() for m in SECRET.finditer(text)}
    return sorted(x for x in found if 6 <= x[1] - x[0] <= LONGEST)


def features(text: str, start: int, end: int) -> list[str]:
    """Of the whole span and of what stands around it."""
    s = text[start:end]
    digits = digits_of(s)
    letters = any(c.isalpha() for c in s)
    cue = WORD_BEFORE.search(text, max(0, start - 24), start)
    groups = "-".join(str(len(x)) for x in re.findall(r"[0-9]+", s)) if not letters else ""
    octets = re.findall(r"[0-9]+", s)
    out = [
        f"n={min(len(digits), 20)}", f"letters={letters}", f"groups={groups[:12]}", f"cue={CUE_OF.get(cue[1].lower(), 'none') if cue else 'none'}",
        f"before={text[start - 1 : start] if text[start - 1 : start] in ' .(-/' else 'x' if start else ''}{text[end : end + 1] if text[end : end + 1] in ' .)-/' else 'x'}",
        f"more={text[max(0, start - 2) : start - 1].isdigit()}{text[end + 1 : end + 2].isdigit()}",
        f"open={s[:1] if not s[:1].isalnum() else s[:2] if s[:2] == '00' else ''}", f"luhn={len(digits) >= 13 and luhn(digits)}", f"octets={len(octets) == 4 and all(int(x) <= 255 for x in octets)}",
        f"seps={''.join(sorted({c for c in s if not c.isalnum()}))[:6]}", f"inside={start > 0 and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()}",
    ]
    if letters and len(s) >= 16 and "@" not in s and " " not in s:
        turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
        out += [f"turns={min(turns * 8 // len(s), 4)}", f"hex={all(c in '0123456789abcdefABCDEF' for c in s)}", f"cases={s != s.lower() and s != s.upper()}", f"length={len(s) // 8}", f"parts={min(sum(c in '_-/+' for c in s), 4)}", f"assigned={text[max(0, start - 3) : start].strip(' ' + chr(34) + chr(39)) in ('=', ':')}"]
    elif letters:
        tail = re.search(r"[A-Za-z0-9-]+\Z", s)
        at = re.search(r"[\[({<]\s?(?:at|AT|@)|@| (?:at|AT) ", s)
        out += [f"at={'word' if at and at[0].strip().lower() == 'at' else 'sign' if at else ''}", f"dot={'word' if re.search(r'(?i)[ \[({<]dot', s) else 'bracket' if re.search(r'[\[({<].[\])}>]', s) else 'plain'}", f"tail={bool(tail and tail[0].isalpha() and tail[0].islower() and 2 <= len(tail[0]) <= 6)}"]
        out.append(out[-3] + "," + out[-2])
    return out


class Field:
    """Weights by (kind, feature); text outside the segments scores nothing."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}

    def scores(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        return self.scores_of([features(text, *s) for s in spans])

    def scores_of(self, found: list[list[str]]) -> np.ndarray:
        get = self.weights.get
        return np.array([[sum(get((k, f), 0.0) for f in fs) + get((k, ""), 0.0) for k in FIELD_KINDS] for fs in found]).reshape(len(found), len(FIELD_KINDS))

    def best(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """Viterbi: the non-overlapping segments and kinds of the highest total score."""
        if not spans:
            return []
        scores, order = self.scores(text, spans), sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0]))
        ends = [spans[i][1] for i in order]
        total, back = [0.0], []
        for n, i in enumerate(order):
            k = int(scores[i].argmax())
            before = bisect_right(ends, spans[i][0], 0, n)
            taken = total[before] + scores[i, k]
            back.append((before, FIELD_KINDS[k], i) if taken > total[n] else None)
            total.append(max(taken, total[n]))
        out, n = [], len(order)
        while n:
            step = back[n - 1]
            if step:
                out.append((step[1], *spans[step[2]]))
            n = step[0] if step else n - 1
        return out[::-1]

    def gradient(self, text: str, spans: list[tuple[int, int]], true: set[tuple[str, int, int]], found: list[list[str]] | None = None) -> dict[tuple[str, str], float]:
        """Of the log likelihood: what is observed less what the field expects (forward and backward sums)."""
        found = found or [features(text, *s) for s in spans]
        scores, order = self.scores_of(found), sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0]))
        ends, starts = [spans[i][1] for i in order], [spans[i][0] for i in order]
        before = [bisect_right(ends, starts[n], 0, n) for n in range(len(order))]
        all_kinds = [float(np.logaddexp.reduce(scores[i])) for i in order]
        ahead = [0.0]
        for n in range(len(order)):
            ahead.append(float(np.logaddexp(ahead[n], ahead[before[n]] + all_kinds[n])))
        behind = [-np.inf] * len(order) + [0.0]
        for n in reversed(range(len(order))):
            behind[n] = float(np.logaddexp(behind[n], behind[n + 1]))
            behind[before[n]] = float(np.logaddexp(behind[before[n]], behind[n + 1] + all_kinds[n]))
        out: dict[tuple[str, str], float] = {}
        for n, i in enumerate(order):
            fs = [*found[i], ""]
            for j, kind in enumerate(FIELD_KINDS):
                expected = float(np.exp(min(0.0, ahead[before[n]] + scores[i, j] + behind[n + 1] - ahead[-1])))
                if d := ((kind, *spans[i]) in true) - expected:
                    for f in fs:
                        out[kind, f] = out.get((kind, f), 0.0) + d
        return out


def sentence(rng: np.random.Generator) -> tuple[str, set[tuple[str, int, int]]]:
    """A made sentence with unusual personal data, or with numbers that are none, and the spans to find."""
    word = lambda: "".join(rng.choice(list("aeioustrnlmdb"), int(rng.integers(2, 8))))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]

    def card() -> str:
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def value(kind: str) -> str:
        if kind == "email":
            at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" @ ", "."))
            return f"{word()}{pick('', '.', '_')}{word()}{at}{pick('', word() + dot)}{word()}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'info')}"
        if kind == "ip":
            return pick("[.]", " dot ", "(.)", "[dot]").join(str(x) for x in rng.integers(1, 256, 4))
        if kind == "card":
            c = card()
            return pick(".", "  ").join(c[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.5 else c[:4] + "." + c[4:8] + "-" + c[8:12] + "." + c[12:]
        a, b, c = digits(3), digits(3), digits(4)
        if kind == "secret":
            letters = pick("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789")
            return "0" + pick("", "sk_", "key-") * (rng.random() < 0.3) + "".join(rng.choice(list(letters), int(rng.integers(20, 64))))
        return pick(f"1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00 {pick('32', '49', '33')} {a} {b} {c}", f"0{digits(3)}/{digits(6)}")

    def other() -> str:
        y = rng.integers(1900, 2100)
        return pick(
            f"{y}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{y}", digits(int(rng.integers(7, 13))), f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot", f"{digits(2)}.{digits(3)}.{digits(3)}", f"{y}-{rng.integers(1900, 2100)}", digits(16), f"{digits(4)}-{digits(4)}", f"{rng.integers(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", f"({y}) {digits(4)}-{digits(3)}", f"{word()}-{word()}-{word()}-{word()}-{y}", f"{word()}/{word()}/{word()}_{digits(3)}/{word()}", f"{word()}_{word()}_{word()}_{digits(2)}", " ".join(digits(int(rng.integers(1, 4))) for _ in range(int(rng.integers(4, 9)))), f"{word()} at {word()}",
        )

    text, true = word(), set()
    for _ in range(int(rng.integers(1, 4))):
        kind = pick(*FIELD_KINDS, None, None, None, None)
        cue = "" if rng.random() < 0.5 else pick(*sorted(CUES[kind or "other"])) + pick(" ", ": ", " = ", "=")
        quote = pick("", "", chr(34)) if kind == "secret" and cue else ""
        text += " " + " ".join(word() for _ in range(int(rng.integers(0, 3)))) + " " + cue
        v = value(kind) if kind else other()
        text += quote
        if kind:
            true.add((kind, len(text), len(text) + len(v)))
        text += v + quote + pick("", ",", ".") + " " + word()
    return text, true


@functools.cache
def trained() -> Field:
    """The field, fitted on SENTENCES made sentences."""
    rng, field = np.random.default_rng(SEED), Field()
    data = []
    for _ in range(SENTENCES):
        text, true = sentence(rng)
        spans = free(text, base_spans(text))
        if spans:
            data.append((text, spans, true, [features(text, *s) for s in spans]))
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(data)):
            rate = RATE / (1 + epoch / 4)
            for key, g in field.gradient(*data[i]).items():
                w = field.weights.get(key, 0.0)
                field.weights[key] = w + rate * (g - PENALTY * w)
    return field


def free(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The candidates that touch no base span."""
    found = candidates(text)
    if not found or not base:
        return found
    taken = np.array(sorted((a, b) for _, a, b in base))
    reach = np.maximum.accumulate(taken[:, 1])  # base spans of different kinds may overlap
    before = np.searchsorted(taken[:, 0], [b for _, b in found])  # base spans that begin before the candidate's end
    return [s for s, k in zip(found, before) if not k or reach[k - 1] <= s[0]]


def order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (FIELD_KINDS.index(s[0]), s[1], s[2]))


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by kind, then start (code points, end exclusive)."""
    base = base_spans(text)
    spans = free(text, base)
    return base, order(base + field.best(text, spans)) if spans else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's kind in its place; overlapping spans count as one, of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_added, n_secret and has_personal of every row.

    Null text counts as empty; an empty table gives an empty result; very long texts are taken whole.
    Rows repeated whole get the same values, each its own row; a null id is kept as it is. Further
    columns, whatever their names, aren't looked at. ``n_added`` counts the field's spans,
    ``n_secret`` those of them that are secrets.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained().weights)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field()
        field.weights = sent.value
        for batch, texts in texts_of(batches):
            found = [find(t, field) for t in texts]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
            added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
            secret = pa.array([sum(s[0] == "secret" for s in every) for _, every in found], pa.int64())
            personal = pa.array([bool(every) for _, every in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(every) for _, every in found], pa.string()), added, secret, personal], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_secret", "has_personal"])

    return rows.mapInArrow(lean(scan), f"doc_id {rows.dtypes[0][1]}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long, n_secret long, has_personal boolean")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with each span of ``text_col`` replaced by its kind, other columns as they were; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(trained().weights)
    at = docs.columns.index(text_col)
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field()
        field.weights = sent.value
        for batch, texts in texts_of(batches, f"c{at}"):
            known = batch.column(at).is_valid().to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([redacted(t, find(t, field)[1]) if there else None for t, there in zip(texts, known)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return numbered.mapInArrow(lean(scan), numbered.schema).toDF(*docs.columns)


def with_length(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``length_col``, where there is one, brought in line with the text."""
    if length_col not in docs.columns:
        return docs
    kind = dict(docs.dtypes)[length_col]
    return docs.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
