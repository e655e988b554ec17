"""Fixed values that results depend on."""

#: Confidence from which a value is reliable; sampling rate.
RELIABLE, HZ = 0.6, 500.0

#: The PQ segment before the QRS onset (ms).
PQ_FROM, PQ_TO = 16.0, 4.0

#: Shares of the median interval below which a beat is premature and from which there is a pause; least intervals for each; shortest run.
EARLY, PAUSE, LEAST_RR, PAUSE_RR, RUN = 0.8, 2.0, 3, 2, 3

#: Tolerance of PQ; by species sinus arrhythmia from this coefficient of variation or this change (ms), a wide and a surely wide QRS (s),
#: widening by print at the onset and the end (ms), the ST point after J (ms).
PQ_TOLERANCE = 0.2
THRESHOLDS = {
    "dog": {"variation": 0.1, "change_ms": 120.0, "wide_s": 0.07, "sure_wide_s": 0.08, "widen_on_ms": 9.3, "widen_off_ms": 7.7, "st_ms": 60.0},
    "cat": {"variation": 0.1, "change_ms": 100.0, "wide_s": 0.04, "sure_wide_s": 0.05, "widen_on_ms": 12.0, "widen_off_ms": 9.8, "st_ms": 40.0},
}
#: Rhythm: least beats, share with P and stable PQ, deviants, precision of PQ in pixels and the default pixel (ms); morphology and template.
TYPE_BEATS, P_SHARE, DEVIANTS, PQ_PX, MS_PER_PX = 3, 0.9, 2, 4, 1000 / (4.305 * 50)
SAME_SHAPE, TEMPLATE_BEATS, SMALL_AREA = 0.8, 3, 0.2
#: Reasons that keep a beat out of measurements; reasons for which a missing P was not assessed; slope of the QT correction.
EXCLUDING = ("hr_implausible", "printed_hr_mismatch", "printed_hr_unverified")
NOT_ASSESSABLE = ("p_window_too_short", "p_lobe_outside_window", "p_duration_out_of_range")
QTC_SLOPE, WAVE_PX, MV_PER_PX = 0.087, 2, 1 / (4.305 * 10)

#: Norms by profile and parameter. (profile, key, unit, low, high, border low, border high, rule); rule: range, abs, abs_fraction (of R), abs_sign
#: (negative is border), border (never worse than border).
NORMS = [
    ("dog-small", "hrMean", "bpm", 70.0, 180.0, 60.0, None, "range"),
    ("dog-large", "hrMean", "bpm", 70.0, 160.0, 60.0, None, "range"),
    ("cat", "hrMean", "bpm", 140.0, 220.0, 120.0, 240.0, "range"),
    ("dog-small", "pDuration", "s", None, 0.04, None, None, "range"),
    ("dog-large", "pDuration", "s", None, 0.04, None, 0.05, "range"),
    ("cat", "pDuration", "s", None, 0.04, None, None, "range"),
    ("dog-small", "pAmplitude", "mV", None, 0.4, None, None, "range"),
    ("dog-large", "pAmplitude", "mV", None, 0.4, None, None, "range"),
    ("cat", "pAmplitude", "mV", None, 0.2, None, None, "range"),
    ("dog-small", "pq", "s", 0.06, 0.13, None, None, "range"),
    ("dog-large", "pq", "s", 0.06, 0.13, None, None, "range"),
    ("cat", "pq", "s", 0.05, 0.09, None, None, "range"),
    ("dog-small", "qrs", "s", None, 0.05, None, 0.06, "range"),
    ("dog-large", "qrs", "s", None, 0.06, None, 0.07, "range"),
    ("cat", "qrs", "s", None, 0.04, None, 0.05, "range"),
    ("dog-small", "r", "mV", None, 2.5, None, None, "range"),
    ("dog-large", "r", "mV", None, 3.0, None, None, "range"),
    ("cat", "r", "mV", None, 0.9, None, None, "range"),
    ("dog-small", "q", "mV", None, 0.5, None, None, "border"),
    ("dog-large", "q", "mV", None, 0.5, None, None, "border"),
    ("dog-small", "qt", "s", 0.15, 0.25, None, None, "range"),
    ("dog-large", "qt", "s", 0.15, 0.25, None, None, "range"),
    ("cat", "qt", "s", 0.12, 0.18, 0.09, 0.2, "range"),
    ("dog-small", "t", "mV", None, 1.0, None, None, "abs_fraction"),
    ("dog-large", "t", "mV", None, 1.0, None, None, "abs_fraction"),
    ("cat", "t", "mV", None, 0.3, None, None, "abs_sign"),
    ("dog-small", "st", "mV", -0.1, 0.1, -0.2, 0.15, "range"),
    ("dog-large", "st", "mV", -0.1, 0.1, -0.2, 0.15, "range"),
    ("cat", "st", "mV", -0.05, 0.05, -0.1, 0.1, "range"),
    ("dog-small", "axis", "deg", 40.0, 100.0, 30.0, 110.0, "range"),
    ("dog-large", "axis", "deg", 40.0, 100.0, 30.0, 110.0, "range"),
    ("cat", "axis", "deg", 0.0, 160.0, -10.0, 170.0, "range"),
]
NORM_SCHEMA = "profile string, key string, unit string, low double, high double, border_low double, border_high double, rule string"
#: A wave of a dog may be this share of R; a border without an explicit bound is this far outside; equality within.
T_OF_R, OUTWARD, EPS = 0.25, 0.1, 1e-9

#: Verdicts by severity.
VERDICTS = ("norm", "border", "abnormal")
