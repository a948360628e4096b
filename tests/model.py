"""A plain sequential model of the change commands, one note at a time."""

import hashlib
import re


def sha(content):
    return hashlib.sha256(content.encode()).hexdigest()


def path_rule(path):
    parts = [p for p in re.split(r"[/\\]+", path) if p]
    if "\0" in path:
        return "NULL_BYTE"
    if path[:1] in ("/", "\\") or re.match(r"[A-Za-z]:[/\\]", path):
        return "ABSOLUTE_PATH"
    if not parts or ".." in parts:
        return "TRAVERSAL"
    if not parts[-1].lower().endswith(".md"):
        return "MARKDOWN_REQUIRED"
    if any(p.startswith(".") or p.lower() == "node_modules" for p in parts[:-1]):
        return "EXCLUDED_PATH"
    return "OK"


def key_of(path):
    return "/".join(p for p in re.split(r"[/\\]+", path) if p)


def run(notes, vaults, commands, trash=()):
    """notes: {(vault, path): content}; vaults: {name: read_only}; trash: {(vault, path)}."""
    notes = dict(notes)
    trash = {k: None for k in trash}
    results = {}
    for c in sorted(commands, key=lambda c: c["seq"]):
        vault, op, path = c["vault"], c["op"], c["path"]
        body, overwrite = c.get("body") or "", bool(c.get("overwrite"))

        def fail(status, at=path):
            results[c["seq"]] = (vault, at, None, status)

        if vault not in vaults:
            fail("NOT_REGISTERED")
            continue
        if vaults[vault]:
            fail("READ_ONLY")
            continue
        if path_rule(path) != "OK":
            fail(path_rule(path))
            continue
        key = (vault, key_of(path))
        here = notes.get(key)
        at = key[1]
        if op == "create":
            if here is not None and not overwrite:
                fail("EXISTS", at)
                continue
            notes[key] = body
        elif op == "append_daily":
            notes[key] = (here or "") + body
        elif here is None:
            fail("NOT_FOUND", at)
            continue
        elif op == "update":
            expected = c.get("expected_hash")
            if expected and sha(here) != expected:
                fail("HASH_MISMATCH", at)
                continue
            notes[key] = body
        elif op == "append":
            notes[key] = here + body
        elif op == "delete":
            base = at.rsplit("/", 1)[-1]
            target = (vault, f".trash/{base}")
            if target in trash:
                mark = hashlib.sha256(f"{vault}\n{at}\n{c['seq']}".encode()).hexdigest()[:32]
                stem, dot, ext = base.rpartition(".")
                target = (vault, f".trash/{stem}-{mark}.{ext}" if stem else f".trash/{base}-{mark}")
            trash[target] = notes.pop(key)
            results[c["seq"]] = (vault, target[1], None, "OK")
            continue
        elif op == "move":
            dest = c.get("dest") or ""
            if path_rule(dest) != "OK":
                fail(path_rule(dest), at)
                continue
            to = (vault, key_of(dest))
            if to in notes and not overwrite:
                fail("EXISTS", at)
                continue
            notes[to] = notes.pop(key)
            results[c["seq"]] = (vault, to[1], sha(notes[to]), "OK")
            continue
        results[c["seq"]] = (vault, at, sha(notes[key]), "OK")
    return notes, {k: v for k, v in trash.items() if v is not None}, results
