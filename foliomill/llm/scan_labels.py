"""The small labelled table the line model of scanned pages is estimated from.

Runs of pages are put together by rule from a seed: a title that returns, page numbers in several styles, paragraphs of invented
words broken at a width, headings, tables and lists, and what is easily mistaken: sentences, headings and counts that return in the body.
Every line carries its label. Nothing of it is taken from the tables the operators are tested on.
"""

from __future__ import annotations

import random

BODY, HEAD, NUMBER, BLANK = range(4)
RUNS, SEED = 400, 11

_ONSETS = "b br c ch d dr f fl g gr h k l m n p pl qu r s sh st t tr v w".split()
_NUCLEI = "a e i o u ai ea ou".split()
_CODAS = ["", "", "n", "r", "l", "s", "nd", "rt", "ck", "m"]


class Pages:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.vocabulary = ["".join(self.r.choice(_ONSETS) + self.r.choice(_NUCLEI) + self.r.choice(_CODAS) for _ in range(self.r.choice([1, 1, 2, 2, 3]))) for _ in range(600)]

    def word(self) -> str:
        return self.r.choice(self.vocabulary)

    def sentence(self) -> str:
        words = [self.word() for _ in range(self.r.randint(5, 16))]
        if self.r.random() < 0.2:
            words[self.r.randrange(len(words))] = str(self.r.randint(1, 400))
        for i in range(1, len(words)):
            if self.r.random() < 0.06:
                words[i] = words[i].capitalize()
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", ".", "?", "!"])

    def title(self) -> str:
        words = [self.word().capitalize() for _ in range(self.r.choice([2, 2, 3, 3, 4, 8, 14, 18]))]
        out = " ".join(words) + self.r.choice(["", "", "", " | Draft 3", " - Volume 4", ". Book 7", " / Restricted"])
        return out.upper() if self.r.random() < 0.3 else out

    def number(self, page: int) -> str:
        return self.r.choice([f"{page}", f"- {page} -", f"[{page}]", f"Page {page}", f"p. {page} of 90", f"{page}/90", f"PAGE {page}"])

    def wrapped(self, text: str, width: int) -> list[str]:
        lines, line = [], ""
        for word in text.split():
            if line and len(line) + 1 + len(word) > width:
                if self.r.random() < 0.15 and len(word) > 5:
                    line += " " + word[:3] + "-"
                    word = word[3:]
                lines.append(line)
                line = word
            else:
                line = f"{line} {word}".strip()
        return [*lines, line]

    def run(self) -> list[list[tuple[str, int]]]:
        """The pages of a run, each a list of (line, label)."""
        title, width = self.title(), self.r.choice([36, 48, 60, 72, 90, 10_000, 10_000])  # some pages come unbroken
        place = self.r.choice(["top", "top", "top", "bottom", "middle"])
        paging = self.r.choice(["none", "beside", "beside", "line", "line", "far", "far", "amid"])
        again = [self.sentence() for _ in range(3)]  # sentences that return
        heading = f"{self.r.randint(1, 12)}.{self.r.randint(1, 12)} {self.word().capitalize()} {self.word()} {self.word()}"
        pages = []
        for page in range(1, self.r.randint(2, 7)):
            blocks = []
            for _ in range(self.r.randint(1, 4)):
                k = self.r.random()
                if k < 0.72:
                    text = " ".join(self.r.choice(again) if self.r.random() < 0.3 else self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5])))
                    blocks.append([(x, BODY) for x in self.wrapped(text, width)])
                elif k < 0.8:
                    blocks.append([(heading if self.r.random() < 0.2 else f"{page}.{self.r.randint(1, 12)} {self.word().capitalize()} {self.word()}", BODY)])
                elif k < 0.9:
                    blocks.append([(f"{self.word().capitalize()} {self.word()}:", BODY), *((str(page if self.r.random() < 0.1 else self.r.randint(1, 900)), BODY) for _ in range(self.r.randint(1, 4)))])
                else:
                    blocks.append([(f"{self.word()} | {self.r.randint(1, 99)} | {self.r.randint(1, 99)} EUR", BODY) for _ in range(self.r.randint(2, 4))])
            number = self.number(page)
            head = [(title, HEAD)] if self.r.random() < 0.92 else []
            if paging == "beside" and head:
                head = [(self.r.choice([f"{title}   {number}", f"{number}   {title}"]), HEAD)]
            elif paging == "line":
                head = [*head, (number, NUMBER)] if self.r.random() < 0.7 else [(number, NUMBER), *head]
            gap = [("", BLANK)] if self.r.random() < 0.7 else []
            out: list[tuple[str, int]] = []
            at = {"top": 0, "bottom": len(blocks), "middle": self.r.randint(1, len(blocks)) if len(blocks) > 1 else 0}[place]
            for i, block in enumerate(blocks):
                if i == at and head:
                    out += [*(gap if i else []), *head, *gap]
                elif i and (self.r.random() < 0.8 or block[0][0][:1].islower()):
                    out.append(("", BLANK))
                out += block
            if at >= len(blocks) and head:
                out += [*gap, *head]
            if paging == "far":
                apart = [("", BLANK)] if self.r.random() < 0.5 else []
                out = [*out, *apart, (number, NUMBER)] if self.r.random() < 0.7 else [(number, NUMBER), *apart, *out]
            elif paging == "amid":
                ends = [i for i in range(1, len(out)) if out[i - 1][0].endswith(".") and out[i][0][:1].isupper()] or [len(out)]
                out.insert(self.r.choice(ends), (number, NUMBER))
            pages.append(out)
        return pages


def table(runs: int = RUNS, seed: int = SEED) -> list[list[list[tuple[str, int]]]]:
    """Runs of pages of (line, label)."""
    p = Pages(seed)
    return [p.run() for _ in range(runs)]
