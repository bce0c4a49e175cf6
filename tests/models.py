"""Sequential reference models used as test oracles (plain Python loops)."""

from __future__ import annotations

import math


def latch_sequence(angles, forms_up, forms_down=None, down_t=90.0, up_t=150.0):
    """Frame-by-frame latch: returns (down, rep_count, form) lists.

    State starts up with form not good; the previous frame's form gates any
    change; the form after the frame depends on the new latch position.
    """
    forms_down = forms_down if forms_down is not None else forms_up
    down, form, reps = False, False, 0
    out_down, out_reps, out_form = [], [], []
    for a, fu, fd in zip(angles, forms_up, forms_down):
        if form:
            if a <= down_t:  # NaN compares false, as in Python
                down = True
            elif a >= up_t:
                if down:
                    down = False
                    reps += 1
        form = fd if down else fu
        out_down.append(down)
        out_reps.append(reps)
        out_form.append(form)
    return out_down, out_reps, out_form


def session_loop(messages):
    """Sequential session loop over (seq, type, value, angle, form) rows.

    Returns kept active frames as dicts with set number, frame, reps, down, done.
    A ``workout`` message makes a new exercise object (latch reset); ``start``
    zeroes the count and activates; completion closes the set.
    """
    exercise, goal, strictness = "push-ups", 0, "loose"
    active = False
    reps = 0
    down, form = False, False
    frame_count = 0
    set_no = 0
    out = []
    for seq, typ, value, angle, fok in sorted(messages, key=lambda m: m[0]):
        if typ == "workout":
            exercise = value if value is not None else "push-ups"
            down, form = False, False
        elif typ == "reps":
            try:
                goal = int(value if value is not None else "1")
            except ValueError:
                pass
        elif typ == "strictness":
            strictness = (value if value is not None else "strict").lower()
        elif typ == "start":
            active = True
            reps = 0
        elif typ == "frame" and active:
            if form:
                if angle <= 90:
                    down = True
                elif angle >= 150 and down:
                    down = False
                    reps += 1
            form = fok
            row = dict(seq=seq, series_number=set_no + 1, frame=frame_count, reps=reps, down=down,
                       exercise=exercise, goal=goal)
            frame_count += 1
            done = goal > 0 and reps >= goal
            row["done"] = done
            out.append(row)
            if done:
                active = False
                frame_count = 0
                set_no += 1
    return out


def angle_deg(p1, p2, p3):
    ux, uy = p1[0] - p2[0], p1[1] - p2[1]
    vx, vy = p3[0] - p2[0], p3[1] - p2[1]
    n = math.sqrt(ux * ux + uy * uy) * math.sqrt(vx * vx + vy * vy)
    if n == 0:
        return float("nan")
    c = (ux * vx + uy * vy) / n
    if c > 1 or c < -1:
        return float("nan")
    return math.degrees(math.acos(c))
