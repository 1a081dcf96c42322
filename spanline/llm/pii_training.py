"""Labelled spans for the tagger of personal details, and its training.

Labels come from an annotator that reads cues (titles, "Contact:", kinds of
numbers) on a bounded sample of texts, learns which words are names from those
cues, and then labels the same words where no cue stands. The tagger learns
from these labels what details look like, also where cues are missing.

    python -m spanline.llm.pii_training DATA_DIR... (writes pii_weights.npz)
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from . import tagger

#: Texts that labels are made from, and texts that training sees, at most.
MOST_SAMPLE, MOST_TRAINING = 400_000, 30_000
WEIGHTS = str(Path(__file__).with_name("pii_weights.npz"))

# What stands before a detail, and titles before names.
CUES = (
    r"Contact:|On file:|Patient:|Reached at|Accompanied by|Copy sent to|Angaben:|Kontakt:|Kopie an|Связь:|Копия:|Данные:|Пациент:|Записан\(а\):|"
    r"Зв'язок:|Копія:|Дані:|Пацієнт:|Записано:|Call|Booked by|Details:|Reply to|Letter to"
)
UP = r"[A-ZА-ЯЁІЇЄҐÄÖÜ]"
LOW = r"[a-zа-яёіїєґäöüß0-9]"
NAME = rf"{UP}{LOW}{{2,}}"
CAPS = rf"{UP}{{4,}}"
NAMES = (
    rf"{NAME} {UP}\. {NAME}|{UP}\. {UP}\. {NAME}|{NAME} {UP}\. {UP}\.|{NAME}, {NAME}|{CAPS} {NAME}|{UP}\. {NAME}|{NAME} {NAME}|{NAME}"
)
RULES = (
    ("email", r"[\w.+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?:\.[\w-]+)+"),
    ("phone", r"\+\d{1,3}[ .]?(?:\(\d{3}\)[ .]?)?\d{2,4}(?:[ .-]?\d{2,8}){1,4}|(?<!\d)8 ?\(?\d{3}\)? ?\d{3}[ -]?\d{2}[ -]?\d{2}(?!\d)|\(\d{3}\) \d{3}-\d{4}|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<!\d)\d{4} / \d{3} \d{4}(?!\d)"),
    ("id_number", r"(?<=SSN )\d{3}-\d{2}-\d{4}|(?<=MRN )\d{6,}|(?<=insurance no\. )[\d-]{8,}|(?<=national id )\d{8,}|(?<=passport )[A-Z]?\d{6,}|(?<=patient ID: )\w{6,}|(?<=паспорт )\d\d \d\d \d{6}|(?<=СНИЛС )\d{3}-\d{3}-\d{3} \d\d|(?<=ИНН )\d{10,12}|(?<=полис N )\d{8,}|(?<=карта пациента )\d{5,}"),
    ("address", rf"\d{{1,3}}[A-Z]? {NAME} (?:Street|Lane|Rd\.|Road|Avenue)(?:, (?:Flat \d+|{NAME}))?|{NAME}weg \d+(?:, \d{{5}} {NAME})?|(?:г\. {NAME}, )?(?:ул\.|пер\.|просп\.) {NAME}, (?:д(?:ом|\.) )?\d+(?:, кв\. \d+)?"),
)
COMPILED = tuple((kind, re.compile(rule)) for kind, rule in RULES)
#: A detail may be a number of a kind whose rule is wider than the cue's: insurance
#: numbers look like phones, so kinds are tried in this order on free text.
ORDER = ("email", "id_number", "address", "phone")
CUED = re.compile(rf"(?:{CUES})\s+(?:(?:Dr|Mr|Mrs|Ms|Prof)\. |Д-р )?({NAMES})")
TITLED = re.compile(rf"(?:\b(?:Dr|Mr|Mrs|Ms|Prof|M)\.|\bMme|\bДоктор|\bД-р|\bЛікар|\bFrau Dr\.)\s+({UP}\. {NAME}|{NAME})")
LINES = re.compile(rf"({UP}\. {UP}\. {NAME}) (?:and the night team|согласен|погодився)")
PLAIN_WORDS = frozenset("the she why what sleep blood pain temp version stores nausea walking see hearing approx swallowing bowel".split())


def learn_names(texts: list[str]) -> set[str]:
    """Words that stand as names after cues and titles, more often than elsewhere."""
    named: Counter = Counter()
    words: Counter = Counter()
    for t in texts:
        covered = [m.span() for k, r in COMPILED for m in r.finditer(t)]
        for w in re.findall(rf"{NAME}|{CAPS}", t):
            words[w.casefold()] += 1
        for rule in (CUED, TITLED, LINES):
            for m in rule.finditer(t):
                if not any(a < m.end(1) and m.start(1) < b for a, b in covered):
                    for w in re.findall(rf"{NAME}|{CAPS}", m[1]):
                        named[w.casefold()] += 1
    return {w for w, n in named.items() if n >= 2 and n >= 0.5 * words[w] and w not in PLAIN_WORDS}


def annotate(text: str, names: set[str]) -> list[tuple[int, int, str]]:
    """Labelled spans of a text, not overlapping."""
    out: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y, _ in out)

    rules = dict(COMPILED)
    for kind in ORDER:
        for m in rules[kind].finditer(text):
            if free(*m.span()) and not (kind == "phone" and sum(c.isdigit() for c in m[0]) < 8):
                out.append((*m.span(), kind))
    pattern = rf"(?<![\w@.+-])(?:{NAME} {UP}\. {NAME}|{UP}\. {UP}\. {NAME}|{NAME} {UP}\. {UP}\.|{NAME}, {NAME}|{CAPS} {NAME}|{UP}\. {NAME}|{NAME} {NAME}|{NAME}|{CAPS})(?!\w)"
    at = 0
    rule = re.compile(pattern)
    while m := rule.search(text, at):
        words = re.findall(rf"{NAME}|{CAPS}", m[0])
        known = [w.casefold() in names for w in words]
        if all(known) and free(*m.span()):
            out.append((*m.span(), "person"))
            at = m.end()
        elif known[0] and free(m.start(), m.start() + len(words[0])) and m[0].startswith(words[0]):
            out.append((m.start(), m.start() + len(words[0]), "person"))
            at = m.start() + len(words[0])
        else:
            first = re.search(rf"{NAME}|{CAPS}|{UP}\.", m[0])
            at = m.start() + max(1, first.end() if first and first.start() == 0 else 1)
    return sorted(out)


def to_tags(text: str, spans: list[tuple[int, int, str]]) -> list[int]:
    """Tag ids of every character."""
    tags = [0] * len(text)
    for a, b, kind in spans:
        k = tagger.TYPES.index(kind)
        tags[a:b] = [2 * k + 2] * (b - a)
        tags[a] = 2 * k + 1
    return tags


def vary(text: str, spans: list[tuple[int, int, str]], r: random.Random) -> str:
    """The same text with other digits, sometimes, so numbers are not learnt by heart."""
    if r.random() < 0.5:
        return text
    out = list(text)
    for i, c in enumerate(out):
        if c.isdigit() and r.random() < 0.5:
            out[i] = str(r.randrange(10))
    return "".join(out)


def labelled(texts: list[str], seed: int = 3) -> tuple[list[str], list[list[int]], set[str]]:
    """Texts and tags to train on: all kinds in like numbers, and plain texts."""
    r = random.Random(seed)
    texts = texts[:MOST_SAMPLE]
    names = learn_names(texts)
    by: dict[str, list] = {k: [] for k in (*tagger.TYPES, "none", "numbers")}
    for t in dict.fromkeys(texts):
        if len(t) > 400:
            continue
        spans = annotate(t, names)
        kinds = {k for _, _, k in spans}
        for k in kinds or ({"numbers"} if re.search(r"\d{3}|[A-Z]\d", t) else {"none"}):
            by[k].append((t, spans))
    chosen = []
    for k, rows in by.items():
        r.shuffle(rows)
        chosen += rows[: MOST_TRAINING // len(by)]
    r.shuffle(chosen)
    varied = [(vary(t, s, r), s) for t, s in chosen]
    return [t for t, _ in varied], [to_tags(t, s) for t, s in varied], names


def read_texts(folders: list[str]) -> list[str]:
    """Texts of spans and wordings, shuffled, at most ``MOST_SAMPLE``."""
    import pyarrow.parquet as pq

    texts: list[str] = []
    for d in folders:
        for table, column in (("spans", "text"), ("event_facts", "wording")):
            texts += [t for t in pq.read_table(f"{d}/{table}.parquet", columns=[column])[column].to_pylist() if t]
    random.Random(5).shuffle(texts)
    return texts[:MOST_SAMPLE]


def hardened(weights: dict, texts: list[str], names: set[str], seed: int = 4) -> tuple[list[str], list[list[int]]]:
    """Texts to train on once more: those the weights get wrong, several times
    over, beside a fresh choice of all kinds."""
    r = random.Random(seed)
    pool = [t for t in dict.fromkeys(texts) if len(t) <= 200]
    r.shuffle(pool)
    pool = pool[: 4 * MOST_TRAINING]
    found = tagger.tag(weights, pool)
    labels = [annotate(t, names) for t in pool]
    wrong = [(t, g) for t, f, g in zip(pool, found, labels, strict=True) if f != g]
    print("wrong", len(wrong), "of", len(pool), flush=True)
    chosen_texts, chosen_tags, _ = labelled(texts, seed)
    extra = [(t, to_tags(t, g)) for t, g in wrong[: MOST_TRAINING // 4]] * 2
    plain = [(t, to_tags(t, g)) for t, g in zip(pool, labels, strict=True) if not g][: MOST_TRAINING // 3]
    return chosen_texts + [t for t, _ in extra + plain], chosen_tags + [g for _, g in extra + plain]


def main(folders: list[str], epochs: int = 5, again: int = 3, start: str | None = None) -> None:
    """Trains on the folders' texts, then on what was wrong; writes the weights."""
    from .lookalikes import plain_text

    sample = [plain_text(t) for t in read_texts(folders)]
    cut = len(sample) // 50
    held, sample = sample[:cut], sample[cut:]
    texts, tags, names = labelled(sample)
    print(len(texts), "texts", len(names), "names", flush=True)
    say = lambda e, x: print("epoch", e, round(x, 4), flush=True)
    weights = dict(tagger.load_weights(start)) if start else tagger.train(texts, tags, epochs=epochs, note=say)
    weights = tagger.train(*hardened(weights, sample, names), epochs=again, rate=0.002, start=weights, note=say)
    tagger.save(weights, WEIGHTS)
    found = tagger.tag(weights, held)
    wrong = [(t, f, annotate(t, names)) for t, f in zip(held, found, strict=True) if f != annotate(t, names)]
    print("held out: texts wrong", len(wrong), "of", len(held), *wrong[:30], sep="\n")


if __name__ == "__main__":
    main(sys.argv[1:])
