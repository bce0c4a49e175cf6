"""Domain constants.

Everything in the block marked FIXED VALUES must equal the behaviour being
reproduced (thresholds, landmark indices, message texts, lookup tables); it is
stated plainly, in natural order, and nowhere else in the package.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES
# ---------------------------------------------------------------------------

N_LANDMARKS = 33

# Landmark index of each body part, (left side, right side).
BODY_PART_INDEX = {
    "shoulder": (11, 12),
    "elbow": (13, 14),
    "wrist": (15, 16),
    "hip": (23, 24),
    "knee": (25, 26),
    "ankle": (27, 28),
    "toes": (31, 32),
}

# Side detection compares the visibility of these two landmarks (left, right).
SIDE_LANDMARKS = (13, 14)

# Repetition latch thresholds in degrees (down at or below, up at or above).
DOWN_THRESHOLD = 90.0
UP_THRESHOLD = 150.0

# Strictness level -> allowed deviation in degrees.
STRICTNESS_DEGREES = {"strict": 5.0, "moderate": 10.0, "loose": 15.0}

# Form-rule parameters.
VARIATION = 5.0
GOAL_BODY_ANGLE = 180.0
ELBOW_THRESHOLD = 165.0

# Start frame: first good frame minus this many frames.
SETUP_BACKTRACK_FRAMES = 10

# Model clock step per decoded frame, in milliseconds (int(1000 / 30)).
FRAME_STEP_MS = 33

# Push-up messages, in output order, and the good label.
PUSHUP_MSG_SHOULDERS = "shoulders not aligned with wrists"
PUSHUP_MSG_KNEES = "knees on floor"
PUSHUP_MSG_BODY = "body not straight"
PUSHUP_GOOD = "Good form"

# Squat messages, in output order, and the good label.
SQUAT_MSG_KNEES_DOWN = "knees not aligned with toes"
SQUAT_MSG_KNEES_UP = "knees not aligned with ankles"
SQUAT_MSG_HIPS_DOWN = "hips angle not between 45 and 90 degrees (angle: {} degrees)"
SQUAT_MSG_HIPS_UP = "You are not standing straight (angle: {} degrees)"
SQUAT_MSG_SHOULDERS = "your shoulders are not over your ankles"
SQUAT_GOOD = "Good form! Keep Going!"

# The analytics filter compares with this label exactly.
GOOD_LABEL_EXACT = "Good form"
# The start-frame rule compares a 4-character prefix with this text.
GOOD_PREFIX = "Good"

# Per-frame default answer when no pose is present.
NO_POSE_MESSAGE = "Initializing..."

# Status messages.
STATUS_PROGRESS = "Current rep count: {}"
STATUS_COMPLETE = "Workout complete! You did {} {}!"
STATUS_SELECTED = "Selected {}. Ready to start!"
STATUS_TARGET = "Set target: {} reps. Ready to start!"

# Control message defaults when the value is missing.
CONTROL_DEFAULTS = {"workout": "push-ups", "reps": "1", "strictness": "strict"}

# Session state before any control message.
INITIAL_EXERCISE = "push-ups"
INITIAL_STRICTNESS = "loose"
INITIAL_GOAL = 0

# Rolling summary handed to the first set of a session.
FIRST_ROLLING_SUMMARY = "No previous sets in this session."

# Fields of a structured coaching response.
RESPONSE_FIELDS = (
    "encouragement",
    "positive_point",
    "main_feedback",
    "secondary_feedback",
    "summary",
    "Rolling_Summary",
)

# What each field is asked to hold, in the prompt.
RESPONSE_NOTES = {
    "encouragement": "one short sentence that greets the effort made",
    "positive_point": "one sentence on something that went well",
    "main_feedback": "the form problem that matters most: what it is, why it matters, how to mend it",
    "secondary_feedback": "further form problems, or the pace and its evenness",
    "summary": "a closing line with the one thing to watch next time",
    "Rolling_Summary": "all sets of the session so far: repetitions, times, form problems and how they change",
}

# Landmark dimension: index, side (None for the nose), name.
LANDMARK_DIMENSION = [
    (0, None, "nose"),
    (1, "left", "inner eye"),
    (2, "left", "eye"),
    (3, "left", "outer eye"),
    (4, "right", "inner eye"),
    (5, "right", "eye"),
    (6, "right", "outer eye"),
    (7, "left", "ear"),
    (8, "right", "ear"),
    (9, "left", "mouth"),
    (10, "right", "mouth"),
    (11, "left", "shoulder"),
    (12, "right", "shoulder"),
    (13, "left", "elbow"),
    (14, "right", "elbow"),
    (15, "left", "wrist"),
    (16, "right", "wrist"),
    (17, "left", "pinky"),
    (18, "right", "pinky"),
    (19, "left", "index"),
    (20, "right", "index"),
    (21, "left", "thumb"),
    (22, "right", "thumb"),
    (23, "left", "hip"),
    (24, "right", "hip"),
    (25, "left", "knee"),
    (26, "right", "knee"),
    (27, "left", "ankle"),
    (28, "right", "ankle"),
    (29, "left", "heel"),
    (30, "right", "heel"),
    (31, "left", "foot index"),
    (32, "right", "foot index"),
]

# Skeleton: 35 undirected landmark pairs drawn as segments.
SKELETON_EDGES = [
    (0, 1), (1, 2), (2, 3), (3, 7), (0, 4), (4, 5),
    (5, 6), (6, 8), (9, 10), (11, 12), (11, 13),
    (13, 15), (15, 17), (15, 19), (15, 21), (17, 19),
    (12, 14), (14, 16), (16, 18), (16, 20), (16, 22),
    (18, 20), (11, 23), (12, 24), (23, 24), (23, 25),
    (24, 26), (25, 27), (26, 28), (27, 29), (28, 30),
    (29, 31), (30, 32), (27, 31), (28, 32),
]

# Client capture: square target size of the letterboxed frame.
LETTERBOX_TARGET = 256

# Disclaimer closing a feedback block; {} is the generation time.
FEEDBACK_ERROR = "Error getting feedback. Please try again later."
FEEDBACK_DISCLAIMER = (
    "Disclaimer: Analysis generated on {}. This analysis was generated using "
    "artificial intelligence and can contain errors."
)

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

EXERCISES = ("push-ups", "squats")
