"""Personal data by a semi-Markov conditional random field, over a base of patterns.

The base finds e-mail addresses, IP addresses, card and phone numbers by fixed patterns;
what it finds always stays. The field adds what the patterns miss: phone numbers without
'+' as four languages write them, numbers that a pattern ran together with what follows,
and secrets. A text's words are cut into segments of up to LONGEST words, or of any number
of words whose digits are no more than MOST_DIGITS (a card's), each either one ordinary word
or an entity of one type; a segment's score comes
from features of the whole span (its length, its digits and other kinds of characters,
its shape, the word before it), and dynamic programming over bounded segments chooses
boundaries and types together. Only segments whose first and last words hold a trigger
are candidates, so that the programme runs over the stretches around such words; the
words between are ordinary in every labelling, at no cost. Triggers are digits, '@', the
openings of known kinds of keys, and runs of 16 letters or more; a shorter secret of
letters alone, without such an opening, is not found. Spans that overlap a base span are
not added.

The weights are fitted on generated sentences (a fixed seed), by the gradient of the
log-likelihood with forward and backward sums over segments; no table is read for it.

Defined results: a null or empty text has no spans. Whole texts are read; offsets are
code points, the end exclusive. Rows are treated alone, so repeated rows and ids agree,
and a text of any length is read whole. Of labellings with the same score the one with
fewer and later entities stays. Columns named like those that are added give way to them.
An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import ready

KINDS = ("email", "ip", "card", "phone", "secret")
LONGEST, MOST_DIGITS = 4, 19

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number's match can only start at the first digit of a run, so looking behind and not
# giving digits back finds the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        i = at
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        if i < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, i, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


#: How keys of known kinds begin.
_KEY = r"(?:AKIA|ASIA|gh[pousr]_|sk_live_|sk_test_|xox[abprs]-|AIza|eyJ)[A-Za-z0-9_\-]{8,}"
_TRIGGER, _WORD = re.compile(rf"[0-9@]+|{_KEY}|[A-Za-z_]{{16,}}"), re.compile(r"[^\s=]+|=+")
_KEYED = re.compile(_KEY)
_OPEN, _CLOSE = "([{<\"'`", ")]}>\"'`.,;:!?*$&%#|"
#: Words before a secret, a phone or a card number, and before numbers and hashes that are
#: no one's, in the tables' four languages.
_SECRET = frozenset("token secret key password passwd pwd passphrase pass passwort kennwort geheim schlüssel contraseña clave secreto passe mdp jeton secrète".split())
_PHONE_CUE = frozenset("tel tél phone telephone call mobile fax telefon telefonnummer rufnummer handy mobil teléfono telefono móvil movil llame llamar téléphone portable appelez numéro".split())
_CARD_CUE = frozenset("card visa mastercard karte kreditkarte kartennummer tarjeta carte bancaire".split())
_PUBLIC = frozenset("commit sha sha1 sha256 md5 isbn issn rev revision hash checksum digest etag doi order part bestellung bestellnummer auftrag pedido commande invoice rechnung factura facture iban ref build serial".split())
_HEX = frozenset("0123456789abcdefABCDEF")
_NUMERIC = re.compile(r"[+(]{0,2}[0-9][0-9().\-/]*[^0-9A-Za-z]*")
_SHAPES = [
    re.compile(p)
    for p in (
        r"0[0-9](?:[ .-][0-9]{2}){4}", r"[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}", r"0[0-9]{1,4}[/ -][0-9]{5,8}", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"\([0-9]{2,5}\) ?[0-9][0-9 -]{4,10}",
        r"[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{1,4}", r"[0-9]{1,3}([ .,][0-9]{3})+", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4})+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"v[0-9].*", r"[A-Z]{2}[0-9]{2}",
        r"[0-9]{4}(?:[ -][0-9]{4}){3}",
    )
]


def features(span: str, words: int, before: str) -> list[float]:
    """Of a whole segment: its text, how many words it has, and the word before it."""
    n = len(span) or 1
    number = "".join(c for c in span if "0" <= c <= "9")
    digits = len(number)
    low, up = sum("a" <= c <= "z" for c in span), sum("A" <= c <= "Z" for c in span)
    letters, dots = low + up, span.count(".")
    marks = sum(c in " ().-/" for c in span)
    cue = {x for x in re.split(r"[_.\-]+", before.lower().strip("=: \"'([{.,;")) if x}
    solid, spelled = words == 1 and "@" not in span, digits + marks + (span[:1] == "+") == n
    secret, phone, card, public = bool(cue & _SECRET), bool(cue & _PHONE_CUE), bool(cue & _CARD_CUE), bool(cue & _PUBLIC)
    hexed, turns = all(c in _HEX for c in span), sum(a.isupper() != b.isupper() for a, b in zip(span, span[1:]))
    address = [len(x) < 4 and x.isdecimal() and int(x) < 256 for x in span.split(".")] if dots == 3 else [False]
    long = 16 <= digits <= 19 and spelled and "(" not in span
    shapes = [float(p.fullmatch(span) is not None) for p in _SHAPES]
    return [
        1.0, 0.0 if spelled else words - 1.0, float(long and luhn(number)), float(long and not luhn(number)), float(10 <= digits <= 13 and spelled), float(8 <= digits <= 9 and spelled), float(digits == 7 and spelled),
        float(digits < 7), float(digits > 19), float(digits >= 7 and not spelled), float("@" in span[1:-1]), float("@" in span and "." in span.rpartition("@")[2]), float(all(address)), float(dots == 3 and letters == 0 and not all(address)),
        float(span[:1] == "+"), float(spelled), float(span[:1] == "0" and spelled and 9 <= digits <= 12), float(solid and n >= 32 and hexed and digits > 4),
        float(solid and n >= 16 and letters + digits >= 0.9 * n and digits >= 2 and letters >= 4), float(solid and n >= 24 and low > 0 and up > 0 and digits > 0), float(solid and _KEYED.fullmatch(span) is not None),
        float(letters > digits), min(n, 48) / 48, float(secret), float(phone), float(phone and spelled and 7 <= digits <= 15), float(card), float(public), float(public and solid and hexed), float(public and digits >= 8), float(_SHAPES[-2].fullmatch(before) is not None),
        float(secret and solid and n >= 8), float(secret and solid and n >= 8 and digits > 0 and letters > 0), float(secret and letters == 0), float(solid and digits == 0), float(solid and digits == 0 and turns >= n / 4),
        float(any(ord(c) > 127 for c in span)), float("/" in span or ":" in span or "," in span), float(span[:3] in ("978", "979") and digits == 13), float("$" in span or "€" in span), float(not cue), *shapes,
    ]


def segments(text: str, words: list[tuple[int, int]], before: str = "") -> list[tuple[int, int, int, int, list[float]]]:
    """Candidates: (first word, words, start, end, features). Up to LONGEST words, or words
    of digits that spell at most MOST_DIGITS."""
    hot = [bool(_TRIGGER.search(text, a, b)) for a, b in words]
    numeric = [sum("0" <= c <= "9" for c in text[a:b]) if _NUMERIC.fullmatch(text, a, b) else MOST_DIGITS + 1 for a, b in words]
    out = []
    for i, (a, b) in enumerate(words):
        # a phone's '+' or an area code may stand apart from the digits that follow
        if not hot[i] and not (text[a] == "+" and b - a == 1):
            continue
        j = i - 1  # the word before, marks apart
        while j >= 0 and i - j < 4 and not text[slice(*words[j])].strip("=: \"'"):
            j -= 1
        cue, spelled = text[slice(*words[j])] if j >= 0 else before, 0
        for n in range(1, len(words) - i + 1):
            spelled += numeric[i + n - 1]
            if n > LONGEST and spelled > MOST_DIGITS:
                break
            if not hot[i + n - 1]:
                continue
            start, end = a, words[i + n - 1][1]
            while end - start > 1 and text[end - 1] in _CLOSE:
                end -= 1
            while end - start > 1 and text[start] in _OPEN and not (text[start] == "(" and text.count("(", start, end) <= text.count(")", start, end)):
                start += 1
            out.append((i, n, start, end, features(text[start:end], n, cue)))
    return out


def decode(weights: np.ndarray, text: str, words: list[tuple[int, int]], before: str = "") -> list[tuple[int, int, int]]:
    """The best labelling's entities, (kind, start, end)."""
    found = segments(text, words, before)
    if not found:
        return []
    scores = np.array([x[4] for x in found]) @ weights
    by_end: dict[int, list[tuple[int, int, float, int, int]]] = {}
    for (i, n, a, b, _), row in zip(found, scores):
        k = int(row.argmax())
        by_end.setdefault(i + n, []).append((i, k, float(row[k]), a, b))
    best, back = [0.0], [None]
    for j in range(1, len(words) + 1):
        top, how = best[j - 1], None
        for x in by_end.get(j, ()):
            if best[x[0]] + x[2] > top:
                top, how = best[x[0]] + x[2], x
        best.append(top)
        back.append(how)
    out, j = [], len(words)
    while j:
        if (x := back[j]) is None:
            j -= 1
        else:
            out.append((x[1], x[3], x[4]))
            j = x[0]
    return out[::-1]


def sentences(n: int, seed: int = 11):
    """Generated sentences: (text, spans of words, entities)."""
    r = random.Random(seed)
    some = lambda k, of: "".join(r.choice(of) for _ in range(k))
    digits = lambda k: some(k, string.digits)
    word = lambda: some(r.randint(2, 11), "etaoinshrdlucmé")
    hexes = lambda k=0: some(k or r.choice([32, 40, 64]), "0123456789abcdef")
    alnum = string.ascii_letters + string.digits

    def checked(k: int) -> str:
        d = digits(k - 1)
        return next(d + c for c in string.digits if luhn(d + c))

    unchecked = lambda k: next(d for d in iter(lambda: digits(k), None) if not luhn(d))
    fours = lambda d, by: by.join(d[k : k + 4] for k in range(0, len(d), 4))
    email = lambda: f"{some(r.randint(2, 9), 'etaoinshrd')}{r.choice(['.', '_', ''])}{digits(r.randint(0, 3))}@{some(r.randint(2, 9), 'etaoinshrd')}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.net'])}"
    card = lambda: r.choice([lambda: checked(16), lambda: fours(checked(16), " "), lambda: fours(checked(16), "-"), lambda: checked(r.randint(17, 19))])()
    mobile = lambda: r.choice("6789") + digits(2)
    phones = [
        lambda: f"+{r.randint(1, 9)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{r.randint(2, 9)}{digits(2)}{r.choice('-.')}{digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}",
        lambda: r.choice(" .-").join(["0" + str(r.randint(1, 9)), *[digits(2) for _ in range(4)]]), lambda: f"0{r.randint(20, 9999)}{r.choice('/ -')}{digits(r.randint(6, 8))}", lambda: r.choice([" ", " ", "-"]).join([mobile(), digits(3), digits(3)]), lambda: f"0{r.randint(150, 179)} {digits(r.randint(7, 8))}",
    ]
    told = [lambda: digits(r.randint(7, 11)), lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"{digits(2)} {digits(2)} {digits(2)} {digits(2)}", *phones]
    keys = [
        lambda: hexes(), lambda: some(r.randint(26, 44), alnum) + digits(2), lambda: "AKIA" + some(16, string.ascii_uppercase + string.digits), lambda: "AKIA" + some(16, string.ascii_uppercase), lambda: r.choice(["ghp_", "gho_"]) + some(36, alnum), lambda: "sk_live_" + some(24, string.ascii_lowercase + string.digits), lambda: some(r.randint(24, 40), string.ascii_letters),
    ]
    short = [lambda: some(r.randint(6, 24), "0123456789abcdef") + digits(2), lambda: some(r.randint(3, 8), "etaoinshrd") + digits(r.randint(1, 4)) + some(r.randint(3, 8), "etaoinshrd"), lambda: some(r.randint(8, 20), alnum) + digits(1), lambda: some(4, string.ascii_letters) + digits(2) + some(r.randint(3, 6), alnum)]
    pick = lambda of: r.choice(of)()
    cue = lambda of: (lambda w: r.choice([w, w.capitalize(), w.upper() if w.isascii() else w]))(r.choice(sorted(of)))
    grouped = lambda by: by.join([r.choice([digits(1), digits(2), r.choice("12345") + digits(2)]).replace("0", "1"), *[digits(3) for _ in range(r.randint(1, 3))]])
    plain = [
        lambda: digits(r.randint(1, 6)), lambda: str(r.randint(1800, 2030)), lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(2)}", lambda: f"{digits(r.randint(1, 3))}.", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{word()}{digits(2)}",
        lambda: f"{r.choice('$€')}{digits(3)},{digits(3)}", lambda: digits(r.randint(20, 30)), lambda: f"@{word()}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"src{digits(1)}/{word()}{digits(2)}", lambda: f"{digits(3)} {digits(3)}", lambda: grouped(r.choice(" .,")), lambda: f"{digits(2)} {digits(2)}",
        lambda: f"{cue(_PUBLIC)}{r.choice([' ', ': ', ' = '])}{hexes()}", lambda: f"{cue(_PUBLIC)}{r.choice([' ', ': '])}{r.choice([unchecked(16), digits(r.randint(8, 12)), fours(unchecked(16), ' ')])}", lambda: f"ISBN{r.choice([':', ''])} 97{r.choice('89')}{r.choice(['-', '', ' '])}{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", lambda: f"97{r.choice('89')}{digits(10)}",
        lambda: "".join(some(r.randint(4, 9), "etaoinshrd") for _ in range(4)), lambda: f"commit {hexes(12)}", lambda: f"{cue(_SECRET)}{r.choice([' ', ' = ', ': '])}{digits(r.randint(1, 5))}", lambda: ".".join([str(r.randint(256, 999)), *[str(r.randint(0, 999)) for _ in range(3)]]), lambda: ".".join([*[str(r.randint(0, 255)) for _ in range(3)], str(r.randint(256, 999))]),
        lambda: unchecked(r.randint(16, 19)), lambda: fours(unchecked(16), r.choice(" -")), lambda: some(2, string.ascii_uppercase) + digits(20), lambda: fours(some(2, string.ascii_uppercase) + digits(20), " "), lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), lambda: f"etag{r.choice([': ', ' ', ': W/'])}\"{hexes(32)}\"",
    ]

    def entity() -> tuple[str, str, int]:
        kind = r.choice([0, 1, 2, 3, 3, 4, 4])
        mark = lambda: r.choice([" ", ": ", " : "])
        if kind == 0:
            return "", email(), 0
        if kind == 1:
            return "", ".".join(str(r.randint(0, 255)) for _ in range(4)), 1
        if kind == 2:
            return r.choice(["", "", cue(_CARD_CUE) + mark()]), card(), 2
        if kind == 3:
            return ("", pick(phones), 3) if r.random() < 0.5 else (cue(_PHONE_CUE) + r.choice([" ", ": ", ". ", " : "]), pick(told), 3)
        lead = cue(_SECRET) if r.random() < 0.7 else r.choice(["api_key", "access_token", "mot de passe", "palabra clave", "client-secret", "db_password"])
        lead += r.choice(["=", ": ", " : ", " = ", '="', ': "', ' = "'])
        return ("", pick(keys), 4) if r.random() < 0.4 else (lead, pick(short) if r.random() < 0.7 else pick(keys), 4)

    for _ in range(n):
        text, truth = "", set()
        for _ in range(r.randint(3, 9)):
            p = r.random()
            if p < 0.3:
                lead, item, k = entity()
                lead = r.choice(["", "", "(", '"']) + lead
                truth.add((k, len(text) + len(lead), len(text) + len(lead) + len(item)))
                text += lead + item + r.choice(["", "", ".", ",", '"', "###", "!!"])
                text += r.choice([" ", "\n"]) + word()  # or else numbers side by side could be read in two ways
            else:
                text += pick(plain) + " " + word() if p < 0.6 else word() + r.choice(["", "", "", ",", "."])
            text += r.choice([" ", " ", " ", "\n"])
        yield text, [m.span() for m in _WORD.finditer(text)], truth


class Lattices:
    """Segments of many sentences as arrays, for sums over all their labellings at once."""

    def __init__(self, data):
        rows = []
        for s, (text, words, truth) in enumerate(data):
            for i, n, a, b, x in segments(text, words):
                rows.append((i + n, s, i, len(words), x, [float((k, a, b) in truth) for k in range(len(KINDS))]))
        rows.sort(key=lambda x: x[:3])
        self.end, self.sentence, self.start, size = (np.array([x[k] for x in rows]) for k in range(4))
        self.phi, self.true = np.array([x[4] for x in rows]), np.array([x[5] for x in rows])
        self.n, self.longest = int(self.sentence.max()) + 1, int(size.max())
        self.last = np.zeros(self.n, np.int64)
        self.last[self.sentence] = size
        self.steps = [self._steps(at) for at in (self.end, self.start)]

    def _steps(self, at: np.ndarray) -> list[tuple]:
        """For each place its segments, by sentence, and where each sentence's begin."""
        order = np.lexsort((self.sentence, at))
        cuts = np.searchsorted(at[order], np.arange(self.longest + 2))
        some = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        return [(x, *np.unique(self.sentence[x], return_index=True)) for x in some]

    def _sums(self, scores: np.ndarray, ahead: bool) -> np.ndarray:
        """Log-sums over labellings of what lies before each place, or (ahead) behind it."""
        out, other = np.zeros((self.longest + 1, self.n)), self.end if ahead else self.start
        for j in range(self.longest - 1, -1, -1) if ahead else range(1, self.longest + 1):
            out[j] = out[j + 1] if ahead else out[j - 1]
            some, whose, first = self.steps[ahead][j]
            if len(some):
                out[j, whose] = np.logaddexp(out[j, whose], np.logaddexp.reduceat(out[other[some], self.sentence[some]] + scores[some], first))
        return out

    def gradient(self, weights: np.ndarray) -> np.ndarray:
        """Of the log-likelihood: features of the true entities less the expected ones."""
        scores = self.phi @ weights
        summed = np.logaddexp.reduce(scores, 1)
        fore, back = self._sums(summed, False), self._sums(summed, True)
        whole = fore[self.last, np.arange(self.n)]
        chance = np.exp(fore[self.start, self.sentence] + back[self.end, self.sentence] - whole[self.sentence])[:, None] * np.exp(scores)
        return self.phi.T @ (self.true - chance)


@lru_cache(1)
def train(n: int = 500, rounds: int = 80) -> np.ndarray:
    """features x kinds, by Adagrad over all sentences at once."""
    lattices = Lattices(sentences(n))
    weights = np.zeros((lattices.phi.shape[1], len(KINDS)))
    seen = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        g = lattices.gradient(weights) / n - 2e-4 * weights
        seen += g * g
        weights += 0.6 * g / np.sqrt(seen)
    return weights


def windows(text: str):
    """Stretches of words around those with a trigger."""
    spans: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = m.span()
        if spans and a < spans[-1][1]:
            continue
        while a and not text[a - 1].isspace():
            a -= 1
        b = m2.start() if (m2 := _SPACE.search(text, b)) else len(text)
        if a >= 2 and text[a - 2] == "+" and text[a - 1] == " ":
            a -= 2
        if spans and a - spans[-1][1] <= 1:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return spans


_SPACE, _BEFORE = re.compile(r"\s"), re.compile(r"([^\s=:\"']+)[\s=:\"']+\Z")


def all_spans(text: str, weights: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    taken = sorted((a, b) for _, a, b in base)
    out = list(base)
    for a, b in windows(text):
        words = [m.span() for m in _WORD.finditer(text, a, b)]
        m = _BEFORE.search(text[max(0, a - 40) : a])
        for k, x, y in decode(weights, text, words, m[1] if m else ""):
            if all(y <= s or x >= e for s, e in taken):
                out.append((k, x, y))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of `docs` without the text, with n_email, n_ip, n_card and n_phone (of
    the base), base (its spans) and spans (all), both written kind:start:end."""
    ready(docs.sparkSession)
    weights = train()
    added = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
    rest = [c for c in docs.columns if c not in (text_col, *added)]
    rows = docs.select(*rest, F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            got = []
            for t in batch.column(len(rest)).to_pylist():
                base = base_spans(t or "") if t and _TRIGGER.search(t) else []
                got.append((base, all_spans(t, weights, base) if t and _TRIGGER.search(t) else []))
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64()) for k in range(4)]
            texts = [pa.array([written(x[i]) for x in got], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *counts, *texts], names=[*rest, *added])

    fields = [T.StructField(c, T.LongType() if c[:2] == "n_" else T.StringType()) for c in added]
    return rows.mapInArrow(run, T.StructType([*rows.select(*rest).schema.fields, *fields]))


def op5_semi_markov_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = F.filter(F.split("spans", "[:0-9,]+"), lambda x: x != "")  # of all spans, the field's too
    return find(docs).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans",
        F.size(kinds).cast("long").alias("n_spans"), F.size(F.filter(kinds, lambda x: x == "secret")).cast("long").alias("n_secret"),
    )
