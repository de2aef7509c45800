"""Command line: manifests and patches of single files. Exit codes: 0 done, 1 an error, 2 wrong usage, 3 a mismatch."""

from __future__ import annotations

import argparse
import json
import os
import sys

from corestrata.functions import fixed
from corestrata.functions.profiles import STABLE, Malformed, Unsupported
from corestrata.sources import manifests, patches
from corestrata.sources.files import publish

OK, ERROR, USAGE, MISMATCH = range(4)
SUITES = {"blake3": fixed.BLAKE3_SUITE, "sha256": fixed.SHA256_SUITE}


def _load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _info(m: manifests.Manifest) -> dict:
    return {"schemaVersion": 1, "hashSuite": m.suite, "profileId": m.profile_id, "profileFingerprint": m.fingerprint.hex(), "manifestId": m.manifest_id.hex(), "fileDigest": m.file_digest.hex() or None, "chunkCount": len(m.records), "contentLength": m.content_length, "physicalLength": m.physical, "blockCount": len(m.blocks), "hasBlockIndex": m.indexed}


def _tell(values: dict, as_json: bool) -> None:
    kept = {k: v for k, v in values.items() if v is not None}
    if as_json:
        print(json.dumps(kept))
    else:
        for k, v in kept.items():
            print(f"{k}={','.join(map(str, v)) if isinstance(v, list) else v}")


def _same_file(a: str, b: str) -> bool:
    return os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


def _store(path: str, data: bytes, inputs: list[str], force: bool) -> None:
    if any(_same_file(path, i) for i in inputs):
        raise ValueError("the output is one of the inputs")
    publish(path, data, force)


def _run(a: argparse.Namespace) -> int:
    if (a.group, a.verb) == ("manifest", "create"):
        m = manifests.create(_load(a.content), STABLE, fixed.STABLE_PROFILE, SUITES[a.suite])
        data = manifests.write(m, a.index)
        _store(a.output, data, [a.content], a.force)
        _tell(_info(manifests.read(data)), a.json)
        return OK
    if (a.group, a.verb) == ("manifest", "inspect"):
        m = manifests.read(_load(a.manifest))
        _tell(_info(m) | {"failures": manifests.names(m.flags)}, a.json)
        return MISMATCH if m.flags else OK
    if (a.group, a.verb) == ("manifest", "verify"):
        outcome, flags = manifests.verify(_load(a.manifest), _load(a.content) if a.content else None)
        _tell({"schemaVersion": 1, "outcome": outcome, "failures": manifests.names(flags)}, a.json)
        return {"valid": OK, "integrity": MISMATCH}.get(outcome, ERROR)
    if a.verb == "plan":
        b, t = (manifests.read(_load(p)) for p in (a.base, a.target))
        if b.suite != t.suite:
            raise ValueError("the manifests' hash suites differ")
        known, seen = {c for c, _ in b.records}, {}
        for c, n in t.records:
            if c not in known:
                seen.setdefault(c, n)
        reused = [n for c, n in t.records if c in known]
        _tell({"schemaVersion": 1, "targetChunks": len(t.records), "targetBytes": t.content_length, "reusedChunks": len(reused), "reusedBytes": sum(reused), "missingChunks": len(t.records) - len(reused), "missingBytes": t.content_length - sum(reused), "uniqueMissingChunks": len(seen), "uniqueMissingBytes": sum(seen.values()), "failures": manifests.names(b.flags | t.flags)}, a.json)
        return MISMATCH if b.flags or t.flags else OK
    if a.verb == "create":
        data = patches.create(_load(a.target_manifest), _load(a.target), _load(a.base_manifest) if a.base_manifest else None, _load(a.base) if a.base else b"", a.level)
        _store(a.output, data, [p for p in (a.target, a.target_manifest, a.base, a.base_manifest) if p], a.force)
        _tell({"schemaVersion": 1, "patchBytes": len(data)} | patches.ledger(data), a.json)
        return OK
    out = patches.apply(_load(a.patch), _load(a.base_manifest) if a.base_manifest else None, _load(a.base) if a.base else b"", a.recheck)
    _store(a.output, out, [p for p in (a.patch, a.base, a.base_manifest) if p], a.force)
    _tell({"schemaVersion": 1, "contentLength": len(out)}, a.json)
    return OK


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corestrata")
    groups = top.add_subparsers(dest="group", required=True)
    for group, verbs in {"manifest": ("create", "inspect", "verify"), "patch": ("plan", "create", "apply")}.items():
        inner = groups.add_parser(group).add_subparsers(dest="verb", required=True)
        for verb in verbs:
            p = inner.add_parser(verb)
            p.add_argument("--json", action="store_true")
            if verb in ("create", "apply"):
                p.add_argument("-o", "--output", required=True)
                p.add_argument("--force", action="store_true")
            if group == "manifest":
                if verb == "create":
                    p.add_argument("content")
                    p.add_argument("--suite", choices=SUITES, default="blake3")
                    p.add_argument("--index", action="store_true")
                else:
                    p.add_argument("manifest")
                    if verb == "verify":
                        p.add_argument("--content")
            elif verb == "plan":
                p.add_argument("base")
                p.add_argument("target")
            else:
                if verb == "create":
                    p.add_argument("target_manifest")
                    p.add_argument("target")
                    p.add_argument("--level", type=int, default=19)
                else:
                    p.add_argument("patch")
                    p.add_argument("--recheck", choices=patches.RECHECKS, default="off")
                p.add_argument("--base-manifest")
                p.add_argument("--base")
    return top


def main(args: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        return _run(a)
    except patches.Rejected as e:
        print(f"rejected: flags {e.flags}", file=sys.stderr)
        return MISMATCH
    except (Malformed, Unsupported, ValueError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return ERROR
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
