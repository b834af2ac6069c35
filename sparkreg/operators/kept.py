"""What tasks remember from one job of a run to the next.

An executor deals its tasks to any of its Python workers, so what only a
worker's memory holds is mostly missed by the next job.  It lies in files of
the executor's own scratch folder instead (the one that PySpark spills to),
which all its workers see and which goes with the executor.  Whoever does not
find a file makes its content anew: nothing here is needed to be right.
"""

from __future__ import annotations

import contextlib
import mmap
import os
import pickle
import shutil
import tempfile

ALIGN = 64


def _roots() -> list[str]:
    return [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d] or [tempfile.gettempdir()]


def place(run: str, name: str) -> str:
    """The file ``name`` of a run, the same one for all workers of an executor."""
    roots = _roots()
    return os.path.join(roots[sum(name.encode()) % len(roots)], f"kept-{run}", name)


def write(path: str, thing) -> None:
    """Arrays go into the file as they are; it appears whole or not at all,
    and for a moment there may be none."""
    arrays: list[pickle.PickleBuffer] = []
    head = pickle.dumps(thing, protocol=5, buffer_callback=arrays.append)
    raw = [a.raw() for a in arrays]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(temp := f"{path}.{os.getpid()}", "wb") as f:
        pickle.dump((len(head), [r.nbytes for r in raw]), f)
        f.write(head)
        for r in raw:
            f.write(bytes(-f.tell() % ALIGN))
            f.write(r)
    with contextlib.suppress(FileNotFoundError):     # a file that takes the place of another is flushed to the disk at once
        os.remove(path)
    os.rename(temp, path)


def read(path: str):
    """What ``write`` was given, or None.  Arrays are views of the file that
    may be written to without changing it."""
    try:
        with open(path, "rb") as f:
            size, sizes = pickle.load(f)
            at, view = f.tell(), memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_COPY))
    except FileNotFoundError:
        return None
    head, parts = view[at:at + size], []
    at += size
    for n in sizes:
        at += -at % ALIGN
        parts.append(view[at:at + n])
        at += n
    return pickle.loads(head, buffers=parts)


def drop(run: str) -> None:
    """Remove the run's files of this executor."""
    for root in _roots():
        shutil.rmtree(os.path.join(root, f"kept-{run}"), ignore_errors=True)
