"""The network edge: full texts from the public law service with their receipts, for one law or a table of them."""

from __future__ import annotations

import hashlib
import http.client
import os
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from pathlib import Path
from urllib.parse import quote, urlencode

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorpusError
from ..profile import DEFAULT, SOURCE_AUTHORITY, SOURCE_FORMAT, Profile
from ..tables import materialise
from .law_parser import MAX_BYTES, Refused, admit, local, parse, shown

SERVICE = "https://laws.e-gov.go.jp/api/2"


def put_new(target: str | Path, content: bytes, code: str) -> Path:
    """Write a file that must not be there yet: linked into place, so nothing is ever replaced."""
    path = Path(target).resolve()
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("wb", dir=path.parent, prefix=f".{path.name}.", delete=False) as part:
        part.write(content)
    try:
        os.link(part.name, path)
    except FileExistsError:
        raise CorpusError(f"{code}: {path}") from None
    finally:
        os.unlink(part.name)
    return path


def _error_code(content: bytes) -> str | None:
    try:
        root = parse(content)
    except Refused:
        return None
    return next((shown(e) for e in root.iter() if local(e.tag) == "code"), None) if local(root.tag) == "error_info" else None


class Unavailable(CorpusError):
    """A request without a body; ``again`` says that a later one may have it, ``pause`` for how many seconds the service wants none."""

    def __init__(self, code: str, *, again: bool = True, pause: float = 0.0):
        super().__init__(code)
        self.again, self.pause = again, pause


def _address(law_id: object, as_of: object, service: str) -> tuple[str, str, str | None]:
    """(endpoint, address with its query, the day in ISO form)."""
    if not isinstance(law_id, str) or not law_id.strip():
        raise CorpusError("EGOV_FETCH_LAW_ID")
    query = {"response_format": "xml", "law_full_text_format": "xml"}
    if as_of is not None:
        try:
            query["asof"] = as_of = date.fromisoformat(as_of).isoformat()
        except (TypeError, ValueError):
            raise CorpusError("EGOV_FETCH_AS_OF") from None
    endpoint = f"{service.rstrip('/')}/law_data/{quote(law_id.strip(), safe='')}"
    return endpoint, f"{endpoint}?{urlencode(query)}", as_of


def _download(address: str, timeout: float, open_url: Callable) -> tuple[bytes, str]:
    """A body and where it came from in the end; read in pieces, refused as soon as it passes the limit of a source."""
    try:
        with open_url(urllib.request.Request(address, headers={"Accept": "application/xml"}), timeout=float(timeout)) as response:
            declared = response.headers.get("content-length") or ""
            if declared.isdigit() and int(declared) > MAX_BYTES:
                raise CorpusError("EGOV_FETCH_TOO_LARGE")
            held = bytearray()
            while piece := response.read(1 << 20):
                held += piece
                if len(held) > MAX_BYTES:
                    raise CorpusError("EGOV_FETCH_TOO_LARGE")
            return bytes(held), response.geturl()
    except urllib.error.HTTPError as failed:
        code, wait = _error_code(failed.read(1 << 20)), (failed.headers.get("Retry-After") if failed.headers else None) or ""
        raise Unavailable(f"EGOV_FETCH_HTTP_{failed.code}" + (f":{code}" if code else ""), again=failed.code == 429 or failed.code >= 500, pause=float(wait) if wait.isdigit() else 0.0) from None
    except TimeoutError:
        raise Unavailable("EGOV_FETCH_TIMEOUT") from None
    except (urllib.error.URLError, http.client.HTTPException, OSError) as failed:
        raise Unavailable("EGOV_FETCH_TIMEOUT" if isinstance(getattr(failed, "reason", None), TimeoutError) else "EGOV_FETCH_NETWORK") from None


def _receipt(content: bytes, final: str, law_id: str, as_of: str | None, profile: Profile) -> dict:
    """The receipt of an admitted body; a bare law takes the id that was asked for."""
    try:
        bare = local(parse(content).tag) == "Law"
        _, law, official = admit(content, law_id if bare else None)
    except Refused:
        raise CorpusError("EGOV_FETCH_XML") from None
    number = next((shown(c) for c in law if local(c.tag) == "LawNum"), "") or None
    now = datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    return {
        "schema": profile.acquisition_schema, "source_authority": SOURCE_AUTHORITY, "source_url": final, "retrieved_at": now, "source_format": SOURCE_FORMAT, "official_law_id": official, "law_number": number,
        "requested_law_id": law_id, "as_of": as_of, "sha256": hashlib.sha256(content).hexdigest(), "rights": None,
    }


def fetch_law(law_id: str, output: str, *, as_of: str | None = None, timeout: float = 30.0, force: bool = False, service: str = SERVICE, open_url: Callable = urllib.request.urlopen, profile: Profile = DEFAULT) -> dict:
    """Save a law's envelope and return what was done; ``acquisition`` in it is the receipt."""
    endpoint, address, as_of = _address(law_id, as_of, service)
    if type(timeout) not in (int, float) or timeout <= 0:
        raise CorpusError("EGOV_FETCH_TIMEOUT_VALUE")
    target = Path(output).resolve()
    if target.exists() and not force:
        raise CorpusError(f"EGOV_FETCH_OUTPUT_EXISTS_REFUSED: {target}")
    content, final = _download(address, timeout, open_url)
    receipt = _receipt(content, final, law_id.strip(), as_of, profile)
    if force and target.exists():
        target.unlink()
    put_new(target, content, "EGOV_FETCH_OUTPUT_EXISTS_REFUSED")
    told = {k: receipt[k] for k in ("as_of", "law_number", "official_law_id", "retrieved_at", "sha256", "source_url")}
    return told | {"acquisition": receipt, "endpoint": endpoint, "law_id": law_id.strip(), "output": str(target)}


RECEIPT = "schema string, source_authority string, source_url string, retrieved_at string, source_format string, official_law_id string, law_number string, requested_law_id string, as_of string, sha256 string, rights string"
FETCHED = f"file string, law_id string, attempts int, diagnostic string, content binary, receipt struct<{RECEIPT.replace(' string', ':string')}>"


@dataclass(frozen=True)
class Fetched:
    """What came of a table of law ids, keyed by ``file``: the law's id, and ``@`` with the day where one was asked for.

    files (file, content, size) and law_ids (file, law_id) go to ``adapt_laws``, receipts (file and
    the receipt's fields) to ``compile_sources``; failures (file, law_id, attempts, diagnostic).
    """

    files: DataFrame
    law_ids: DataFrame
    receipts: DataFrame
    failures: DataFrame


def _fetch_all(batches: Iterator[pa.RecordBatch], *, schema: pa.Schema, gap: float, retries: int, pause: float, timeout: float, service: str, open_url: Callable, profile: Profile) -> Iterator[pa.RecordBatch]:
    """Each law of a task, one request after another and ``gap`` seconds or more between their starts."""
    due = 0.0
    for batch in batches:
        for asked in batch.to_pylist():
            row = {"file": asked["file"], "law_id": asked["law_id"], "attempts": 0}
            try:
                _, address, as_of = _address(asked["law_id"], asked["as_of"], service)
                while "content" not in row:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due, row["attempts"] = time.monotonic() + gap, row["attempts"] + 1
                    try:
                        content, final = _download(address, timeout, open_url)
                        row |= {"receipt": _receipt(content, final, asked["law_id"], as_of, profile), "content": content}
                    except Unavailable as failed:
                        if not failed.again or row["attempts"] > retries:
                            raise
                        due = max(due, time.monotonic() + max(failed.pause, pause * 2 ** (row["attempts"] - 1)))
            except CorpusError as failed:
                row["diagnostic"] = str(failed)
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def fetch_laws(laws: DataFrame, *, tasks: int = 4, per_second: float = 2.0, retries: int = 3, pause: float = 1.0, timeout: float = 30.0, service: str = SERVICE, open_url: Callable = urllib.request.urlopen, profile: Profile = DEFAULT) -> Fetched:
    """Full texts of a table of laws (law_id, and as_of where days are asked for), each pair once.

    The laws are dealt to ``tasks`` tasks, each of which makes its share of ``per_second`` requests,
    so however many run at once, the service sees no more than that many a second (and a first
    request of each task). Refusals for load, server errors, timeouts and broken connections are tried
    again ``retries`` times, after ``pause`` seconds that double each time, or as long as the service
    says. What is refused for good is a row of ``failures`` and stops nothing; a null or blank id is
    one too. Bodies are written to the shared folder once, before anything reads them. A task that is lost asks
    again for its own share; run without speculation, which would ask twice. Other columns of ``laws`` are not read.
    """
    from functools import partial

    from pyspark.sql.pandas.types import to_arrow_schema

    if tasks < 1 or per_second <= 0 or retries < 0 or timeout <= 0:
        raise CorpusError("EGOV_FETCH_OPTIONS")
    day = F.col("as_of").cast("string") if "as_of" in laws.columns else F.lit(None).cast("string")
    asked = laws.select(F.trim(F.col("law_id").cast("string")).alias("law_id"), day.alias("as_of")).distinct()
    asked = asked.select(F.concat_ws("@", F.coalesce("law_id", F.lit("")), "as_of").alias("file"), "law_id", "as_of").repartition(tasks, "file")
    run = partial(_fetch_all, schema=to_arrow_schema(T.StructType.fromDDL(FETCHED)), gap=tasks / per_second, retries=retries, pause=pause, timeout=timeout, service=service, open_url=open_url, profile=profile)
    found = materialise(asked.mapInArrow(run, FETCHED))
    good = found.where("diagnostic IS NULL")
    return Fetched(
        good.select("file", "content", F.octet_length("content").cast("long").alias("size")),
        good.select("file", "law_id"),
        good.select("file", "receipt.*"),
        found.where("diagnostic IS NOT NULL").select("file", "law_id", "attempts", "diagnostic"),
    )
