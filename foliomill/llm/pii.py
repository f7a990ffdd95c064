"""Personal information inside free text: e-mail addresses, telephone and identity numbers, street addresses and names of persons.

A linear-chain conditional random field over word-shape features tags tokens; it is trained here, in numpy, on the small labelled
table of `pii_labels`. A mail address, a run of digit groups or a code is one token. Every feature belongs to one token and to the
offset at which a neighbour sees it, so at work the emissions of a batch are a few table look-ups by distinct word, and
Viterbi runs over all texts of a batch at once. An exact check follows: a person needs two words, an address a number and a street.

Every mention comes from the field: the tokeniser's formats (a mail address, an insurance number) are features of it, no more.

Defined cases. Null and blank texts have no mentions and come out unchanged. Texts of any length are tagged whole: Viterbi runs from the
first token to the last, and only the emissions are worked out in blocks of CHUNK tokens. Repeated rows are tagged each. Only ocr_id and text
are read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_labels

KINDS = ("email", "phone", "id_number", "address", "person")
TAGS = ("O", "B-email", "B-phone", "B-id_number", "B-address", "I-address", "B-person", "I-person")
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
#: Tokens whose emissions are worked out at once, and tokens (with padding) that are decoded together: bounds of memory, not of texts.
CHUNK, BATCH_TOKENS = 4_096, 65_536
EPOCHS, RATE, DECAY = 8, 0.2, 1e-5
#: Share of the word features left out at random in training, so that shapes and classes carry wording that isn't in the table.
DROPPED = 0.3

_SH, _NS, _HY = chr(0xAD), chr(0xAC), chr(0x2010)
_BR = rf"(?:[-{_SH}{_NS}{_HY}][ \t]*\n[ \t]*)"
_AT = r"(?:@|\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?)"
_DOT = r"(?:\.|\[dot\]|\s?\(dot\)\s?)"
_USER = rf"[\w](?:[\w.+-]|\[dot\]|{_BR})*"
_MAIL = rf"<?(?:mailto:)?{_USER}{_AT}\w(?:[\w-]|{_BR})*(?:{_DOT}(?:\n(?=[a-z]))?\w(?:[\w-]|{_BR})*)*{_DOT}(?:\n(?=[a-z]))?[^\W\d_]{{2,}}>?"
_TOKEN = re.compile(
    rf"(?P<MAIL>{_MAIL})"
    r"|(?P<NI>\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b)"
    r"|(?P<FILE>\b[A-Z]{2}-\s?\d+(?:/\d+|-[A-Z]\b)?)"
    r"|(?P<NUM>\+?\(?\d+\)?(?:(?:[ \n./-]|\s?\(0?\)|\s?[-/]\s?|\)\s?|\s\()?\(?\d+\)?)*(?:-[A-Z]\b|[A-Z](?![\w])|[a-z](?!\w))?(?:\s?ext\.?\s?\d+)?)(?![A-Za-z\d])"
    r"|(?P<CODE>(?=[A-Z\d]*\d)(?=[A-Z\d]*[A-Z])[A-Z\d]{3,})"
    r"|(?P<LANE>\bC/)"
    rf"|(?P<WORD>[^\W\d_]+(?:['’][^\W\d_]+|{_BR}[^\W\d_]+|-[^\W\d_]+)*)"
    r"|(?P<ORD>\d+\.?[ºª°])"
    r"|(?P<PUNCT>\S)"
)
_SPLIT = re.compile(rf"{_BR}|\s+")

# Words that the features know as a class.
CLASSES = {
    "title": "mr mrs ms miss dr prof herr frau herrn mme mlle m me sr sra d dña dott sig sir madam",
    "street": "street st road rd avenue ave lane ln close terrace row walk way drive court place square crescent hill gardens rue chemin quai allée boulevard impasse bd passage sentier cours calle avda ronda glorieta avenida paseo plaza camino travesía via viale piazza straat laan",
    "unit": "flat apt unit apartment suite floor",
    "idword": "passport ssn security insurance ni licence license identity steuer-id personalausweis reisepass führerschein sozialversicherungsnummer passeport sécurité permis dni nie pasaporte permiso tax fiscal",
    "phoneword": "phone tel telephone telefon telefonisch call appeler llamar number fax mobile handy téléphone teléfono",
    "otherword": "policy order meter reading part invoice commande pièce compteur bestellung teil zählerstand pedido pieza contador marcaba version page file account room chapter readings seite página pagina bladzijde",
    "firmword": "limited ltd gmbh office works committee board company firma société empresa verwaltung quay bridge mill valley wharf depot barge ship",
    "month": "january february march april may june july august september october november december monday friday",
}
_CLASS = {w: c for c, ws in CLASSES.items() for w in ws.split()}
_STREET_END = re.compile(r"(?:straße|strasse|str|weg|gasse|ufer|allee|platz|damm|kamp|ring|hof|steig|pfad|markt|wall|straat|laan)$")


def tokenise(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, token, start, end); line breaks and the hyphens before them are taken out of tokens."""
    return [(m.lastgroup or "PUNCT", _SPLIT.sub(lambda x: "" if x[0][0] in "-" + _SH + _NS + _HY else " ", m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def features(kind: str, token: str, known: frozenset[str]) -> list[str]:
    """The features of one token, of its shape and of its class."""
    out = ["k=" + kind]
    if kind == "WORD":
        low = token.lower()
        shape = "X" if len(token) == 1 and token.isupper() else "XX" if token.isupper() else "Xx" if token[0].isupper() else "xx"
        if shape == "Xx" and any(c.isupper() for c in token[1:]):
            shape = "XxX"
        out.append("s=" + shape)
        c = _CLASS.get(low)
        if c and (c not in ("title", "street") or shape != "xx" or low in ("rue", "avenue", "chemin", "quai", "allée", "boulevard", "place")):
            out.append("c=" + c)
        if len(low) > 4 and shape != "xx" and _STREET_END.search(low):
            out.append("c=streetend")
        if low in known:
            out.append("w=" + low)
        elif shape in ("Xx", "XX", "XxX"):
            out.append("unknown" + shape)
    elif kind in ("NUM", "ORD"):
        n = sum(map(str.isdigit, token))
        groups = re.findall(r"\d+", token)
        out += [f"n={min(n, 13)}", f"g={min(len(groups), 5)}", "first0" if token.lstrip("+(").startswith("0") else "first"]
        out += ["has" + c for c in "+(/.-" if c in token]
        out += ["ext"] if "ext" in token else []
        out += ["letter"] if token[-1].isalpha() and "ext" not in token else []
        out.append("p=" + re.sub(r"\d", "9", token)[:16])
        out.append("gs=" + ",".join(str(len(g)) for g in groups[:5]))
    elif kind == "CODE":
        out.append("p=" + re.sub(r"\d+", "9", re.sub(r"[A-Z]+", "A", token)))
        out.append(f"n={min(sum(map(str.isdigit, token)), 12)}")
    elif kind == "PUNCT":
        out.append("t=" + token)
    return out


class Tagger:
    """The conditional random field: weights of features by offset and tag, and of neighbouring tags."""

    def __init__(self, rows: list[list[tuple[str, str]]]) -> None:
        texts, labels = [], []
        for pieces in rows:
            text, spans = "", []
            for kind, part in pieces:
                if kind:
                    spans.append((len(text), len(text) + len(part), kind))
                text += part
            tokens = tokenise(text)
            tags = []
            for _, _, a, b in tokens:
                tag = 0
                for x, y, kind in spans:
                    if a < y and b > x:
                        inside = f"I-{kind}" in TAGS and any(x <= a2 < a for _, _, a2, _ in tokens if a2 < a)
                        tag = TAGS.index(f"I-{kind}" if inside else f"B-{kind}")
                tags.append(tag)
            texts.append(tokens)
            labels.append(tags)
        counts: dict[str, int] = {}
        for pieces in rows:
            for kind, part in pieces:
                if not kind:
                    for w in set(re.findall(r"[^\W\d_]+", part.lower())):
                        counts[w] = counts.get(w, 0) + 1
        self.known = frozenset(w for w, n in counts.items() if n >= 8) - {w for g in pii_labels.GIVEN for w in g.lower().split("-")}
        self.index: dict[str, int] = {}
        self._fit(texts, labels)

    def _ids(self, kind: str, token: str, grow: bool) -> list[int]:
        found = features(kind, token, self.known)
        if grow:
            return [self.index.setdefault(f, len(self.index)) for f in found]
        return [self.index[f] for f in found if f in self.index]

    def _fit(self, texts: list, labels: list) -> None:
        """Stochastic gradient (AdaGrad) on the exact log-likelihood, by forward-backward over batches of equal length."""
        t = len(TAGS)
        words: dict[tuple[str, str], int] = {}
        seqs = [np.array([words.setdefault((k, w), len(words)) for k, w, _, _ in x] or [0]) for x in texts]
        if not words:
            words[("PUNCT", ".")] = 0
        lists = [self._ids(k, w, True) for k, w in words]
        width = max(map(len, lists))
        m = len(self.index)
        table = np.full((len(words) + 1, width), m)  # the last row is the padding word, the last feature has no weight
        for i, ids in enumerate(lists):
            table[i, : len(ids)] = ids
        self.weights = np.zeros((len(OFFSETS), m + 1, t))
        self.steps = np.zeros((t, t))
        worded = np.zeros(m + 1, bool)
        worded[[i for f, i in self.index.items() if f.startswith("w=")]] = True
        gw, gs = np.full_like(self.weights, 1e-8), np.full_like(self.steps, 1e-8)
        order = np.argsort([len(s) for s in seqs], kind="stable")
        batches = [order[i : i + 64] for i in range(0, len(order), 64)]
        rng = np.random.default_rng(5)
        pad = max(OFFSETS)
        for epoch in range(EPOCHS):
            for bi in rng.permutation(len(batches)):
                rows = [i for i in batches[bi] if len(labels[i])]
                if not rows:
                    continue
                n = max(len(seqs[i]) for i in rows)
                ids = np.full((len(rows), n + 2 * pad), len(words))
                gold, mask = np.zeros((len(rows), n), int), np.zeros((len(rows), n), bool)
                for r, i in enumerate(rows):
                    ids[r, pad : pad + len(seqs[i])] = seqs[i]
                    gold[r, : len(seqs[i])] = labels[i]
                    mask[r, : len(seqs[i])] = True
                feats = table[ids]
                feats = np.where(worded[feats] & (rng.random(feats.shape) < DROPPED), m, feats)
                e = np.zeros((len(rows), n, t))
                for o, off in enumerate(OFFSETS):
                    e += self.weights[o][feats[:, pad + off : pad + off + n]].sum(axis=2)
                node, edge = _marginals(e, self.steps, mask)
                dn = -node
                dn[np.arange(len(rows))[:, None], np.arange(n), gold] += 1
                dn[~mask] = 0
                de = -edge
                both = mask[:, 1:]
                np.add.at(de, (gold[:, :-1][both], gold[:, 1:][both]), 1)
                for o, off in enumerate(OFFSETS):
                    grad = np.zeros((m + 1, t))
                    f = feats[:, pad + off : pad + off + n]
                    np.add.at(grad, f.reshape(-1), np.repeat(dn.reshape(-1, t), width, axis=0))
                    grad[m] = 0
                    hit = np.unique(f)
                    grad[hit] -= DECAY * self.weights[o][hit]
                    gw[o][hit] += grad[hit] ** 2
                    self.weights[o][hit] += RATE * grad[hit] / np.sqrt(gw[o][hit])
                    self.weights[o][m] = 0
                gs += de**2
                self.steps += RATE * de / np.sqrt(gs)
        # only a B or I may come before an I of its kind
        for kind in ("address", "person"):
            ok = [TAGS.index(f"B-{kind}"), TAGS.index(f"I-{kind}")]
            for a in range(t):
                if a not in ok:
                    self.steps[a, ok[1]] = -100.0
        self.weights = self.weights.astype(np.float32)

    def arrays(self) -> dict:
        """All of it as plain objects, which a worker without this package can unpickle."""
        return dict(vars(self))

    @classmethod
    def of(cls, arrays: dict) -> Tagger:
        tagger = cls.__new__(cls)
        vars(tagger).update(arrays)
        return tagger

    def emissions_of(self, kind: str, token: str) -> np.ndarray:
        """What the token adds to the scores at each offset."""
        ids = self._ids(kind, token, False)
        return self.weights[:, ids].sum(axis=1) if ids else np.zeros((len(OFFSETS), len(TAGS)), np.float32)


def _marginals(e: np.ndarray, steps: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: probabilities of the tags of each token, and summed over neighbours, of each pair of tags."""
    b, n, t = e.shape
    s = np.exp(steps)
    f, z = np.zeros((b, n, t)), np.zeros((b, n))
    x = np.exp(e - e.max(axis=2, keepdims=True))
    for i in range(n):
        f[:, i] = x[:, i] if i == 0 else np.where(mask[:, i, None], (f[:, i - 1] @ s) * x[:, i], f[:, i - 1])
        z[:, i] = f[:, i].sum(axis=1)
        f[:, i] /= z[:, i, None]
    back = np.ones((b, n, t))
    edge = np.zeros((t, t))
    for i in range(n - 2, -1, -1):
        y = x[:, i + 1] * back[:, i + 1] / z[:, i + 1, None]
        live = mask[:, i + 1]
        back[:, i] = np.where(live[:, None], y @ s.T, back[:, i + 1])
        edge += np.einsum("bi,bj->ij", f[:, i][live], y[live]) * s
    node = f * back
    node /= node.sum(axis=2, keepdims=True)
    return node, edge


def viterbi(blocks: Iterator[np.ndarray], steps: np.ndarray, sizes: np.ndarray, t: int = len(TAGS)) -> np.ndarray:
    """The best tags of a batch of sequences padded to one length, whose emissions come in blocks along the sequences."""
    b, n = len(sizes), int(sizes.max())
    best = np.zeros((b, t), np.float32)
    best[:, [TAGS.index("I-address"), TAGS.index("I-person")]] = -100
    back = np.zeros((n, b, t), np.int8)
    own = np.arange(t)
    i = 0
    for e in blocks:
        for k in range(e.shape[1]):
            if i == 0:
                best = best + e[:, 0]
            else:
                step = best[:, :, None] + steps
                live = (i < sizes)[:, None]
                back[i] = np.where(live, step.argmax(axis=1), own)
                best = np.where(live, step.max(axis=1) + e[:, k], best)
            i += 1
    out = np.zeros((b, n), np.int8)
    out[:, n - 1] = best.argmax(axis=1)
    for i in range(n - 1, 0, -1):
        out[:, i - 1] = back[i][np.arange(b), out[:, i]]
    return out


class Decoder:
    """A tagger at work: the emissions of each distinct token are kept."""

    KEPT = 200_000

    def __init__(self, tagger: Tagger) -> None:
        self.tagger = tagger
        self.rows: dict[tuple[str, str], int] = {}
        self.table = np.zeros((1024, len(OFFSETS), len(TAGS)), np.float32)

    def _row(self, key: tuple[str, str]) -> int:
        row = self.rows.get(key)
        if row is None:
            row = len(self.rows) + 1  # row 0 is the padding
            if row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[row] = self.tagger.emissions_of(*key)
            self.rows[key] = row
        return row

    def tag(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Mentions of each text: (kind, start, end) in order."""
        if len(self.rows) > self.KEPT:
            self.rows.clear()
        parts = [tokenise(text) if text else [] for text in texts]
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        order = sorted((i for i, tokens in enumerate(parts) if tokens), key=lambda i: len(parts[i]))
        at = 0
        while at < len(order):
            # sequences of about one length, as many as BATCH_TOKENS hold, at least one
            take = 1
            while at + take < len(order) and take < 64 and (take + 1) * len(parts[order[at + take]]) <= BATCH_TOKENS:
                take += 1
            some = order[at : at + take]
            at += take
            for i, tags in zip(some, self._decode([parts[i] for i in some])):
                out[i] = mentions(parts[i], tags, self.tagger.known)
        return out

    def _decode(self, sequences: list[list]) -> list[np.ndarray]:
        """The tags of the tokens of each sequence."""
        pad = max(OFFSETS)
        sizes = np.array([len(tokens) for tokens in sequences])
        n = int(sizes.max())
        ids = np.zeros((len(sequences), n + 2 * pad), np.int64)
        for r, tokens in enumerate(sequences):
            ids[r, pad : pad + sizes[r]] = [self._row((k, w)) for k, w, _, _ in tokens]

        def emissions() -> Iterator[np.ndarray]:
            for a in range(0, n, CHUNK):
                m = min(CHUNK, n - a)
                e = np.zeros((len(sequences), m, len(TAGS)), np.float32)
                for o, off in enumerate(OFFSETS):
                    e += self.table[ids[:, pad + a + off : pad + a + off + m], o]
                yield e

        tags = viterbi(emissions(), self.tagger.steps.astype(np.float32), sizes)
        return [tags[r, :size] for r, size in enumerate(sizes)]


def mentions(tokens: list, tags: np.ndarray, known: frozenset[str]) -> list[tuple[str, int, int]]:
    """Spans of the tags, after the exact check."""
    spans: list[list] = []
    for j, tag in enumerate(tags):
        name = TAGS[tag]
        if name[0] == "B":
            spans.append([name[2:], j, j])
        elif name[0] == "I" and spans and spans[-1][2] == j - 1 and spans[-1][0] == name[2:]:
            spans[-1][2] = j
    out: list[tuple[str, int, int]] = []
    last = None
    worded = any(x[0] == "WORD" and len(x[1]) > 1 for x in tokens)
    for kind, a, b in spans:
        if kind == "person":
            b = _end_of_name(tokens, a, b)
        while b > a and tokens[b][0] == "PUNCT" and tokens[b][1] != ".":
            b -= 1
        inside = tokens[a : b + 1]
        if kind == "email":
            ok = inside[0][0] == "MAIL"
        elif kind == "phone":
            ok = worded and _is_phone(inside[0])
        elif kind == "id_number":
            ok = worded and inside[0][0] in ("NI", "CODE", "NUM") and sum(map(str.isdigit, inside[0][1])) >= 5
        elif kind == "person":
            ok = _is_name(inside, known)
        else:
            # two pieces of one address stand side by side
            if last is not None and a - last[2] <= 2 and all(x[1] in ",;in" for x in tokens[last[2] + 1 : a]):
                a = last[1]
                inside = tokens[a : b + 1]
                if out and out[-1][0] == "address" and out[-1][1] == inside[0][2]:
                    out.pop()
            last = (kind, a, b)
            ok = any(x[0] in ("NUM", "ORD", "CODE") for x in inside) and any(_is_street(x) for x in inside)
        if ok:
            out.append((kind, inside[0][2], inside[-1][3]))
    return out


def _is_phone(token: tuple) -> bool:
    digits = re.sub(r"\D", "", token[1])
    groups = re.findall(r"\d+", token[1])
    return token[0] == "NUM" and 6 <= len(digits) <= 15 and len(set(digits)) > 1 and sum(len(g) == 1 for g in groups) <= 2 and len(groups) <= 7


def _is_street(token: tuple) -> bool:
    low = token[1].lower()
    return token[0] == "LANE" or token[0] == "WORD" and (_CLASS.get(low) == "street" or _STREET_END.search(low) is not None)


# What may stand inside a name in lower case.
_PARTICLES = set("de del la van von der den di da du le zu y e".split())


def _end_of_name(tokens: list, a: int, b: int) -> int:
    """A name ends at a full stop that belongs to no initial or title."""
    for j in range(a + 1, b + 1):
        if tokens[j][1] == "." and not (len(tokens[j - 1][1]) == 1 or _CLASS.get(tokens[j - 1][1].lower()) == "title"):
            return j - 1
    return b


def _is_name(inside: list, known: frozenset[str]) -> bool:
    words = [x[1] for x in inside if x[0] == "WORD"]
    if len(words) < 2 or any(x[0] != "WORD" and x[1] not in (",", ".") for x in inside):
        return False
    names = [w for w in words if _CLASS.get(w.lower()) != "title"]
    if not any(len(w) > 2 for w in names) or any(w[0].islower() and w not in _PARTICLES for w in names):
        return False
    # words that the labelled table has outside names
    return not any(_CLASS.get(w.lower()) in ("firmword", "street", "month", "otherword") or (len(w) > 2 and w.lower() in known and w.lower() not in _PARTICLES) for w in names)


@functools.lru_cache(maxsize=4)
def fit(rows: int = pii_labels.ROWS, seed: int = 7) -> Tagger:
    """Trains the tagger on the labelled table: a few seconds, once a process."""
    return Tagger(pii_labels.table(rows, seed))


#: Texts that are tagged at once; bounds the memory of a Python worker.
TEXTS = 512


def _tagged(df: DataFrame, schema: str, rows_of) -> DataFrame:
    """mapInPandas over (ocr_id, text) with one decoder a task; rows_of turns (ids, texts, decoder) into a frame."""
    shared = df.sparkSession.sparkContext.broadcast(fit().arrays())  # some MB of weights, bounded by the labelled table

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(Tagger.of(shared.value))
        for pdf in batches:
            for at in range(0, len(pdf), TEXTS):
                part = pdf.iloc[at : at + TEXTS]
                yield rows_of(part["ocr_id"], [t if isinstance(t, str) else None for t in part["text"]], decoder)

    return df.select("ocr_id", "text").mapInPandas(run, schema)


def found(df: DataFrame) -> DataFrame:
    """ocr_id, pii_kind, occ: one row for each mention."""

    def rows_of(ids: pd.Series, texts: list[str | None], decoder: Decoder) -> pd.DataFrame:
        rows = []
        for ocr_id, spans in zip(ids, decoder.tag([t or "" for t in texts])):
            seen: dict[str, int] = {}
            for kind, _, _ in spans:
                seen[kind] = seen.get(kind, 0) + 1
                rows.append((ocr_id, kind, seen[kind]))
        return pd.DataFrame(rows, columns=["ocr_id", "pii_kind", "occ"])

    return _tagged(df.where(F.col("text").isNotNull()), "ocr_id long, pii_kind string, occ int", rows_of)


def redact(texts: list[str | None], decoder: Decoder) -> list[str | None]:
    """The texts with each mention replaced by its kind in brackets, everything else kept."""
    out: list[str | None] = []
    for text, spans in zip(texts, decoder.tag([t or "" for t in texts])):
        if not text:
            out.append(text)
            continue
        done, at = [], 0
        for kind, a, b in spans:
            done += [text[at:a], f"[{kind.upper()}]"]
            at = b
        out.append("".join([*done, text[at:]]))
    return out


def redacted(df: DataFrame) -> DataFrame:
    """ocr_id, text of every row."""
    return _tagged(df, "ocr_id long, text string", lambda ids, texts, decoder: pd.DataFrame({"ocr_id": ids, "text": redact(texts, decoder)}))
