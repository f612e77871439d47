"""Carrying out moves on a mounted file system, on the driver: each is in the ledger before it is made."""

from __future__ import annotations

import os
from collections.abc import Iterable

from reelsift.sources.sinks import append_log


def carry_out(root: str, moves: Iterable[tuple[str, str]], log: str, batch: str) -> int:
    """Make ``moves`` (from, to, below ``root``) in their order and return how many were made.

    A move is logged as pending, made, and logged as done; what crashes in between is found by the ledger's operators.  A
    target that exists is never overwritten: FileExistsError.  A shadow ('._x') whose file system moved it along with its
    main file is logged as auto; one that is nowhere is skipped.  Another device than the root's is an OSError, before anything moves.
    """
    pairs = [(a, b, os.path.join(root, a), os.path.join(root, b)) for a, b in moves]
    device = os.stat(root).st_dev
    for a, _, src, _ in pairs:
        if os.path.exists(src) and os.lstat(src).st_dev != device:
            raise OSError(f"on another device: {a}")
    made = 0
    for seq, (a, b, src, dst) in enumerate(pairs, 1):
        there = os.path.exists(dst)
        if os.path.basename(a).startswith("._") and not os.path.exists(src):
            if there:
                append_log(log, {"batch": batch, "seq": seq, "src": a, "dst": b, "state": "auto"})
            continue
        if there:
            raise FileExistsError(b)
        append_log(log, {"batch": batch, "seq": seq, "src": a, "dst": b, "state": "pending"})
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        os.rename(src, dst)
        append_log(log, {"batch": batch, "seq": seq, "state": "done"})
        made += 1
    return made
