"""F1 of round 4: only pieces that may have a partner are sorted by their suffixes."""

import random

from gaugework.llm import suffixes


def covered(pieces):
    """What a shard finds, and what it should find: (piece, start) of windows a smaller doc_id has."""
    shard = suffixes.Shard()
    for doc, piece in enumerate(pieces):
        shard.add(piece, doc, [(doc, 0, 0)])
    found = {(p, a + k) for part in shard.covered() for p, a, n in zip(*(c.tolist() for c in part), strict=True) for k in range(n)}
    first, wanted = {}, set()
    for doc, piece in enumerate(pieces):
        for i in range(len(piece) - suffixes.WINDOW + 1):
            if first.setdefault(piece[i : i + suffixes.WINDOW], doc) < doc:
                wanted.add((doc, i))
    return found, wanted


def test_only_pieces_with_a_partner_are_sorted(monkeypatch):
    sizes, real = [], suffixes.suffix_array

    def counted(text, depth):
        sizes.append(len(text))
        return real(text, depth)

    monkeypatch.setattr(suffixes, "suffix_array", counted)
    r = random.Random(4)
    bytes_of = lambda n, letters=b"ab\0\xff": bytes(r.choice(letters) for _ in range(n))
    anchor = bytes_of(suffixes.GRAM)
    strangers = [bytes_of(34) + anchor + bytes_of(34) for _ in range(200)]
    assert covered(strangers) == (set(), set()) and not sizes  # before: 17 000 symbols were sorted
    same = bytes_of(20) + anchor + bytes_of(14)
    partners = [bytes_of(20) + same + bytes_of(14), bytes_of(3) + same, same + bytes_of(30)]
    pieces = strangers[:100] + partners[:1] + strangers[100:] + partners[1:]
    found, wanted = covered(pieces)
    assert found == wanted == {(201, 3), (202, 0)}
    assert sizes == [sum(len(p) + 1 for p in partners) + 1]


def test_partners_are_found_at_every_place():
    r = random.Random(5)
    for _ in range(60):
        some = [bytes(r.choice(b"ab") for _ in range(r.randint(50, 84))) for _ in range(4)]
        cuts = [(p[r.randint(0, 9) :] + some[0])[: r.randint(50, 84)] for p in some]
        pieces = sorted({*some, *(c for c in cuts if len(c) >= suffixes.WINDOW), some[1][:50]}, key=lambda _: r.random())
        found, wanted = covered(pieces)
        assert found == wanted
