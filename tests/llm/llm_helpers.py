"""Brute-force versions that the operators are held against."""

import hashlib
import re
import zlib


def base_spans(text):
    """Brute-force base spans of personal data: [(start, kind_no, stop, kind)]."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for n, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))
                    or kind == "card" and not (14 <= len(d) <= 19 and luhn) or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def near_groups(docs, words, percent):
    """Brute force: {(doc_id, set size, smallest linked doc_id)} of (doc_id, text) pairs."""
    sets = {}
    for i, text in docs:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        x = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        grams = {tuple(x[k:k + words]) for k in range(len(x) - words + 1)} if len(x) >= words else ({tuple(x)} if x else set())
        sets.setdefault(i, []).append(grams)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, g) for i, gs in sets.items() if i is not None for g in gs if g]
    for n, (i, g) in enumerate(flat):
        for j, h in flat[:n]:
            if min(len(g), len(h)) * 100 >= percent * max(len(g), len(h)):
                shared = len(g & h)
                if 100 * shared >= percent * (len(g) + len(h) - shared):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return sorted(((i, len(g), find(i)) for i, gs in sets.items() for g in gs), key=str)


def token_ids(text):
    """Ids by the tokenizers library, with the end id."""
    global _TOKENIZER
    if _TOKENIZER is None:
        import public_tokenizers
        from tokenizers import Tokenizer
        _TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return _TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


_TOKENIZER = None


def crc(ids):
    import numpy as np
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha1(data):
    return hashlib.sha1(data).hexdigest()
