"""Queries over the streaming compactor."""

from __future__ import annotations

from tidecurve.streaming import compactor

QUERIES = {
    "p2_found": compactor.found,
    "p2_compacted": compactor.compacted,
    "p2_frames": compactor.frames_per_video,
}

_DIRECTORY = r"""regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(dirpath)), '\', '/'),
    '(^|/)(\./+)+', '\1', 'g'), '/(\./|/)*', '/', 'g'), '(/frames)?(/\.?)?$', '')"""
_ORDINAL = r"nullif(regexp_extract(lower(file_name), 'frame_0*(\d+)_\d+h\d+m\d+s', 1), '')"
_NAME = r"regexp_extract(lower(id), '([a-z]+_[a-z]+)[^a-z0-9]+(\d+_[0-9a-f]+)', {})"

_RECORDS = f"""f as (select file_id as rec_key, {_DIRECTORY} as a, {_ORDINAL} as b from frame_files where n_bytes <> 0),
        t as (select rec_id as rec_key, split as a, {_NAME.format(1)} as b, {_NAME.format(2)} as c, md5(hex(img)) as d
              from tfrecords where octet_length(img) > 0)"""

ORACLE = {
    "p2_found": f"""
        with {_RECORDS}
        select 'frame_files' as store, rec_key from
          (select rec_key, min(rec_key) over (partition by a, b) as kept from f where b is not null) where rec_key <> kept
        union all
        select 'tfrecords' as store, rec_key from
          (select rec_key, min(rec_key) over (partition by a, b, c, d) as kept from t) where rec_key <> kept""",
    # up to 128 MB a store the live files are one
    "p2_compacted": f"""
        with {_RECORDS}, r as (select 'frame_files' as store, count(*) as rows_with_record, count(distinct (a, b)) as records from f where b is not null
        union all select 'tfrecords', count(*), count(distinct (a, b, c, d)) from t)
        select store, rows_with_record, records, records as rows, 1::bigint as files from r""",
    "p2_frames": f"""
        with w as (select {_DIRECTORY} as directory, max(num_frames)::bigint as num_frames from videopath where dirpath is not null group by 1),
        l as (select directory, count(distinct ordinal) as frames from
              (select {_DIRECTORY} as directory, {_ORDINAL} as ordinal from frame_files where n_bytes <> 0)
              where ordinal is not null group by 1)
        select coalesce(w.directory, l.directory) as directory, coalesce(frames, 0) as frames, num_frames,
               coalesce(frames, 0) - num_frames as surplus
        from w full join l on w.directory = l.directory""",
}
