"""Writes compound files for tests: a plain layout of the format, with hooks to damage it."""

from __future__ import annotations

import struct

END, FREE, TABLE, NONE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFF


def compound_file(streams: dict[str, bytes], shift: int = 9, damage=None, shuffled: bool = False) -> bytes:
    """`damage(table, small_table, entries)` may change the tables before they are written."""
    size, cutoff, small = 1 << shift, 4096, 64
    sectors: list[bytes] = []
    table: list[int] = []

    def chain(data: bytes) -> int:
        n = -(-len(data) // size)
        if not n:
            return END
        at = list(range(len(sectors), len(sectors) + n))
        if shuffled:  # every other sector later: no two neighbours follow each other
            at = at[::2] + at[1::2]
        pieces = {a: data[k * size : (k + 1) * size].ljust(size, b"\0") for k, a in enumerate(at)}
        sectors.extend(pieces[k] for k in sorted(pieces))
        table.extend([END] * n)
        for a, b in zip(at, at[1:]):
            table[a] = b
        return at[0]

    names = ["Root Entry"]
    for path in streams:
        steps = path.split("/")
        names += [p for p in ("/".join(steps[:k]) for k in range(1, len(steps))) if p not in names]
    entries = [{"path": n, "kind": 1, "start": 0, "size": 0} for n in names]
    entries[0]["kind"] = 5
    held, small_table = b"", []
    for path, data in streams.items():
        if len(data) >= cutoff:
            start = chain(data)
        else:
            n = -(-len(data) // small)
            start = len(small_table) if n else END
            small_table += [len(small_table) + k + 1 for k in range(n - 1)] + [END] * bool(n)
            held += data.ljust(n * small, b"\0")
        entries.append({"path": path, "kind": 2, "start": start, "size": len(data)})
    entries[0]["start"], entries[0]["size"] = chain(held), len(held)
    for e in entries:
        e |= {"left": NONE, "right": NONE, "child": NONE}
    for k, e in enumerate(entries):  # children of a storage: a list to the right
        own = [j for j, c in enumerate(entries) if j and (c["path"].rpartition("/")[0] or "Root Entry") == e["path"]]
        if own:
            e["child"] = own[0]
        for a, b in zip(own, own[1:]):
            entries[a]["right"] = b
    if damage:
        damage(table, small_table, entries)
    small_start = chain(struct.pack(f"<{len(small_table)}I", *small_table).ljust(-(-max(1, len(small_table)) * 4 // size) * size, b"\xff")) if small_table else END
    raw = b""
    for e in entries:
        name = e["path"].rpartition("/")[2].encode("utf-16-le") + b"\0\0"
        raw += name.ljust(64, b"\0") + struct.pack("<HBB3I", len(name), e["kind"], 1, e["left"], e["right"], e["child"]) + bytes(36) + struct.pack("<IQ", e["start"], e["size"])
    directory = chain(raw.ljust(-(-len(raw) // size) * size, b"\0"))
    each = size // 4
    count, further = 1, 0
    while True:
        further = -(-max(0, count - 109) // (each - 1))
        if count * each >= len(table) + count + further:
            break
        count += 1
    own = list(range(len(sectors), len(sectors) + count))
    more = list(range(len(sectors) + count, len(sectors) + count + further))
    full = table + [TABLE] * count + [0xFFFFFFFC] * further
    full += [FREE] * (count * each - len(full))
    body = b"".join(sectors) + struct.pack(f"<{len(full)}I", *full)
    rest = own[109:]
    for k in range(further):
        part = rest[k * (each - 1) : (k + 1) * (each - 1)]
        body += struct.pack(f"<{each}I", *part, *[FREE] * (each - 1 - len(part)), more[k + 1] if k + 1 < further else END)
    first = (own + [FREE] * 109)[:109]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 4 if shift == 12 else 3, 0xFFFE, shift, 6) + bytes(6)
    head += struct.pack("<8I", 0, count, directory, 0, cutoff, small_start, -(-len(small_table) * 4 // size), more[0] if more else END)
    head += struct.pack("<I", further) + struct.pack("<109I", *first)
    return head.ljust(size, b"\0") + body
