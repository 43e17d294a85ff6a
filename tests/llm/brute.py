"""Plain Python versions of the operators, written apart from them."""

import hashlib
import re
from collections import Counter, defaultdict

ENGLISH = "the of and to in is was for that with on as by it from are this be at or an have not which their has".split()
FRENCH = "le la les des est une dans que qui pour avec sur par plus ce pas ne sont au du et il elle nous vous".split()
ENDINGS = {"en": ["tion", "ing", "ness", "ly", "ed", "ble"], "fr": ["ement", "eau", "eux", "ière", "oir", "ée"]}
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, s):
    number = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 8 <= len(number) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if valid(k, m.group())]


def masked(text, spans):
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def leak_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def leaks(text, items):
    """(n_words, n_hit, sorted item ids as text) of one document."""
    words = leak_words(text)
    hit, ids = set(), set()
    for item, item_text in items:
        own = leak_words(item_text)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update((i, i + 1, i + 2))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def near_classes(rows, split, threshold=0.8):
    """id -> smallest id of its group, over all pairs of texts that share a shingle."""
    texts = defaultdict(list)
    for i, text in rows:
        if split(text):
            texts[tuple(split(text))].append(i)
    bags = [Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else Counter([w]) for w in texts]
    size, having, parent = [sum(b.values()) for b in bags], defaultdict(list), list(range(len(bags)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, bag in enumerate(bags):
        common = Counter()
        for s, n in bag.items():
            for j in having[s]:
                common[j] += min(n, bags[j][s])
            having[s].append(k)
        for j, n in common.items():
            if n / (size[k] + size[j] - n) >= threshold:
                parent[find(k)] = find(j)
    members = defaultdict(list)
    for k, ids in enumerate(texts.values()):
        members[find(k)] += ids
    out = {i: min(ids) for ids in members.values() for i in ids}
    return {i: out.get(i, i) for i, _ in rows}


def prose(rng, lang, n):
    common = ENGLISH if lang == "en" else FRENCH
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(2)) for _ in range(n)]
    return " ".join(rng.choice(common) if rng.random() < 0.45 else s + rng.choice(ENDINGS[lang]) for s in stems)


def letter_terms(text):
    """Runs of letters and of characters beyond ASCII, A to Z lower-cased."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
