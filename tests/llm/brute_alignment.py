"""Whole texts through both tokenizers, aligned one by one."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

FOLDER = "/opt/tokenizers"


def encoders(folder=FOLDER):
    """(text -> its A tokens as (id, bytes), text -> its B tokens)."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    assert isinstance(a.decoder, decoders.ByteLevel)
    kept = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    table = {chr(c): c for c in kept} | {chr(256 + k): c for k, c in enumerate(x for x in range(256) if x not in kept)}

    def of_a(text):
        return [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]

    return of_a, of_b


def placed(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def alignment(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each (doc_id, text)."""
    of_a, of_b = encoders()
    kept, count = [], Counter()
    for doc_id, text in rows:
        a, b = (of_a(text), of_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not (b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)):
            a, b = [], []
        pa, pb = placed(a), placed(b)
        cuts = sorted({e for _, _, e in pa} & {e for _, _, e in pb})
        ga, gb = defaultdict(list), defaultdict(list)
        for g, p in ((ga, pa), (gb, pb)):
            for i, _, e in p:
                g[bisect_left(cuts, e)].append(str(i))
        links, first = [], 0
        for i, s, e in pa:
            while pb[first][2] <= s:
                first += 1
            k = first
            while k < len(pb) and pb[k][1] < e:
                links.append((i, pb[k][0]))
                k += 1
        count.update(links)
        kept.append((doc_id, len(a), len(b), [f"{','.join(ga[k])}|{','.join(gb[k])}" for k in range(len(cuts))], links))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, na, nb, len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if links else "") for d, na, nb, g, links in kept]
