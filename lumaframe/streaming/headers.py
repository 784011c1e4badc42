"""Slice headers of streams that arrive in chunks: parameter sets and picture order are state, kept for each stream across batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumaframe.sources.annexb import parse_pps, parse_slice_header, parse_sps, slice_pps_id

#: Bytes of a slice that its header may take: 64 weights of six values and all list edits fit.
HEAD_BYTES = 1 << 15
_FIELDS = ["first_mb", "slice_type", "frame_num", "is_idr", "poc_lsb", "qp", "num_ref_l0", "num_ref_l1", "parse_status"]
HEADERS = "stream_id string, nal_idx long, ref_idc int, width int, height int, first_mb long, slice_type int, frame_num long, is_idr boolean, poc_lsb long, qp int, num_ref_l0 int, num_ref_l1 int, parse_status string, full_poc long"
_STATE = "sets binary, msb long, lsb long"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One stream's units of one batch, after all that came before."""
    sets, msb, lsb = state.get if state.exists else (pickle.dumps(({}, {})), 0, None)
    sps, pps = pickle.loads(sets)
    units = sorted((tuple(r) for part in parts for r in part[["nal_idx", "ref_idc", "nal_type", "payload"]].itertuples(index=False)), key=lambda r: r[0])
    rows = []
    for number, ref_idc, kind, payload in units:
        payload = bytes(payload)
        if kind == 7:
            found = parse_sps(payload)
            sps[found["sps_id"]] = found
        elif kind == 8:
            found = parse_pps(payload)
            pps[found["pps_id"]] = found
        elif kind in (1, 5):
            p = pps.get(slice_pps_id(payload))
            s = sps.get(p["sps_id"]) if p else None
            row = {"stream_id": key[0], "nal_idx": number, "ref_idc": ref_idc, "parse_status": "no parameter set"}
            if s:
                h, _ = parse_slice_header(payload, kind, ref_idc, s, p)
                now, modulus = h["poc_lsb"], 1 << s["log2_max_poc_lsb"]
                if h["is_idr"]:
                    msb, lsb = 0, None
                if lsb is not None and modulus > 1:
                    msb += modulus if lsb - now >= modulus // 2 else -modulus if now - lsb > modulus // 2 else 0
                lsb = now
                row |= {"width": s["width"], "height": s["height"], **{c: h[c] for c in _FIELDS}, "full_poc": msb + now}
            rows.append(row)
    state.update((pickle.dumps((sps, pps)), msb, lsb))
    names = [c.split()[0] for c in HEADERS.split(", ")]
    # Objects, so that numbers beside nulls stay whole.
    yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def arriving_headers(units: DataFrame) -> DataFrame:
    """The header of each slice of a stream of units (stream_id, nal_idx, ref_idc, nal_type, payload), with full_poc, its unwrapped picture order.

    Units of one stream arrive in order of nal_idx, cut into batches anywhere;
    inside a batch they may come in any order. A slice uses the sets that were
    in force at its place, whichever batch brought them; one that names a
    missing set has only its place and status. The state of a stream is its
    parameter sets and one picture order, whatever its length. Headers only:
    payloads are cut to HEAD_BYTES before they are shuffled.
    """
    heads = units.where(F.col("nal_type").isin(1, 5, 7, 8)).select(F.col("stream_id").cast("string"), F.col("nal_idx").cast("long"), "ref_idc", "nal_type", F.substring("payload", 1, HEAD_BYTES).alias("payload"))
    return heads.groupBy("stream_id").applyInPandasWithState(_advance, HEADERS, _STATE, "append", GroupStateTimeout.NoTimeout)
