"""Plain sequential models of the detectors, written from their descriptions, as the yardstick of the window forms."""

import math


def raw_dips(rows, baseline):
    """rows: (t, d) in order -> list of (start, end) positions."""
    out, i = [], 0
    while i < len(rows):
        if rows[i][1] is not None and rows[i][1] < baseline:
            start = max(0, i - 1)
            while i < len(rows) and rows[i][1] is not None and rows[i][1] < baseline:
                i += 1
            out.append((start, min(i, len(rows) - 1)))
        else:
            i += 1
    return out


def merge(dips, rows, gap):
    out = []
    for s, e in dips:
        if out and rows[s][0] - rows[out[-1][1]][0] < gap:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def events(rows, line, gap):
    """The batch counter: (start, end) positions; ends are shared with the next start where they touch."""
    out, i = [], 0
    while i < len(rows):
        if not rows[i][1] < line:
            i += 1
            continue
        start, last, end = max(0, i - 1), rows[i][0], None
        for j in range(i + 1, len(rows)):
            if rows[j][1] < line:
                last = rows[j][0]
            elif rows[j][0] - last > gap:
                end = j
                break
        if end is None:
            out.append((start, len(rows) - 1))
            break
        out.append((start, end))
        i = end + 1
    return out


def live_events(rows, line, gap):
    out, state, start, last, prev = [], "idle", None, None, None
    for i, (t, d) in enumerate(rows):
        below = d < line
        if state == "idle":
            if below:
                state, start, last = "in", (i if prev is None else prev), t
        elif state == "in":
            if below:
                last = t
            else:
                state = "wait"
        elif below:
            state, last = "in", t
        elif t - last > gap:
            out.append((start, i))
            state = "idle"
        prev = i
    return out


def compact_events(rows, line, capacity, least):
    out, buf, start = [], None, None
    for t, d in rows:
        if buf is None:
            if d < line:
                buf, start = [d], t
        elif d < line:
            if len(buf) == capacity:
                buf = None
            else:
                buf.append(d)
        else:
            if t - start >= least:
                m = sum(buf) / len(buf)
                out.append((start, t, len(buf), sum((x - m) ** 2 for x in buf) / len(buf)))
            buf = None
    return out


def track(rows, p):
    """rows: (frame, idx, class, x1, y1, x2, y2) in order -> (object_id, is_new) for each."""

    def like(a, b):
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        s, t = area(a), area(b)
        ratio = min(s, t) / max(s, t) if max(s, t) > 0 else 0
        dist = math.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
        size = math.sqrt((s + t) / 2) if s + t > 0 else 0
        return 0.4 * ratio + 0.6 * (max(0, 1 - dist / size / 2) if size > 0 else 0)

    tracks, out, next_id = {}, [], 1
    for frame, _, cls, *box in rows:
        tracks = {k: v for k, v in tracks.items() if frame - v["hist"][-1][0] <= p.retention_frames}
        best, found = p.similarity, None
        for k, v in tracks.items():
            if (s := like(box, v["hist"][-1][1])) > best:
                best, found = s, k
        if found is None:
            found, next_id = next_id, next_id + 1
            tracks[found] = {"hist": [], "counted": False}
        v = tracks[found]
        v["hist"].append((frame, box))
        seconds = (frame - v["hist"][0][0]) / p.fps
        ok = False
        if not v["counted"]:
            if cls == 2:
                ratios = [(b[2] - b[0]) / (b[3] - b[1]) for _, b in v["hist"] if b[3] > b[1]]
                areas = [(b[2] - b[0]) * (b[3] - b[1]) for _, b in v["hist"]]
                mean = sum(areas) / len(areas)
                cv = math.sqrt(sum((a - mean) ** 2 for a in areas) / len(areas)) / mean if mean > 0 else 0
                ok = seconds >= p.vehicle_seconds and bool(ratios) and p.min_aspect <= sum(ratios) / len(ratios) <= p.max_aspect and (len(areas) <= 2 or cv <= p.max_area_cv)
            elif cls == 0:
                ok = seconds >= p.person_seconds
            else:
                ok = seconds > p.other_seconds
            v["counted"] = ok
        out.append((found, ok))
    return out
