"""Wording of conclusions and result tables, as data. {name} is filled in; a code without an entry has a fallback."""

LABELS = {
    "hr": "Heart rate", "pDuration": "P duration", "pAmplitude": "P amplitude", "pq": "PQ interval", "q": "Q amplitude", "qrs": "QRS duration", "r": "R amplitude",
    "s": "S amplitude", "qt": "QT interval", "qtc": "Corrected QT", "t": "T amplitude", "st": "ST segment", "axis": "Electrical axis",
}
TABLE = {"unreliable": "unreliable", "no_norm": "no range", "no_axis": "no axis", "confidence": "confidence {confidence}", "share": "{pct} % of R"}
REASONS = {
    "no_beats": "no beats found", "no_pages": "no sheets", "no_signals": "no signals", "all_leads_unreliable": "no lead is reliable", "lead_ii_unreliable": "lead II is unreliable", "low_confidence": "low confidence",
    "too_few_beats": "too few beats", "p_not_found": "no P wave found", "p_not_all": "not every beat has a P wave", "pq_unstable": "PQ varies", "t_not_found": "no T wave found",
    "species_not_applicable": "not defined for the species", "axis_leads_unreliable": "leads I or aVF are unreliable", "q_absent": "Q too small", "r_absent": "R too small", "s_absent": "S too small",
}
NO_REASON = "reason unknown"
RHYTHM = {"sinus": "Sinus rhythm", "non_sinus": "Rhythm other than sinus", "undetermined": "Rhythm undetermined"}
P_COUNTED = "P before {found} of {total} beats"
HR = {
    "range": "Rate {mean} bpm ({min} to {max}), range {norm}{verdict}.", "mean": "Rate {mean} bpm, range {norm}{verdict}.", "no_norm": "Rate {mean} bpm{range} (no range for the species).",
    "unreliable": "Rate not determined.", "border": ", borderline", "abnormal_above": ", too fast", "abnormal_below": ", too slow",
}
AXIS = {
    "none": "Axis not determined.", "norm": "Axis {value}, within {norm}.", "border": "Axis {value}, borderline ({norm}).", "abnormal_below": "Axis {value}, left of {norm}.",
    "abnormal_above": "Axis {value}, right of {norm}.", "n/a": "Axis {value} (no range for the species).",
}
ARRHYTHMIA = {"dog": "Sinus arrhythmia, usual in dogs.", "cat": "Sinus arrhythmia, unusual in cats."}
PAUSE = "Pause of {duration} ms at {start} s, to be looked at."
DEVIATIONS = {"none": "All measured values are within their ranges.", "list": "Outside the range: {items}.", "border": "Borderline: {items}.", "item": "{label} {value}, {direction} (range {norm})"}
DIRECTIONS = {
    "default:abnormal_above": "above", "default:abnormal_below": "below", "default:abnormal_deep": "too deep", "default:border_above": "at the upper bound", "default:border_below": "at the lower bound",
    "default:border_deep": "borderline depth", "default:border_sign": "negative", "default:border_inside": "borderline", "q:border_above": "deep Q", "q:border_deep": "deep Q",
    "st:abnormal_above": "elevated", "st:abnormal_below": "depressed", "st:border_above": "slightly elevated", "st:border_below": "slightly depressed",
    "t:border_sign": "negative T", "t:abnormal_deep": "deep negative T", "t:border_deep": "negative T of borderline depth",
}
FOCI = {"atrial": "atria", "junctional": "junction", "left_ventricle": "left ventricle", "right_ventricle": "right ventricle", "unknown": "unknown focus"}
ECTOPICS = {"none": "No ectopic beats.", "list": "Ectopic beats: {items}.", "item": "{count} {kind} ({foci}; {coupling})", "single": "coupling {value} ms", "many": "coupling {min} to {max} ms, mean {mean}", "unreliable": "Ectopic beats not judged: {reason}."}
KINDS = {"SVE": ("supraventricular beat", "supraventricular beats"), "VE": ("ventricular beat", "ventricular beats")}
EPISODES = {"none": "No episodes.", "list": "Episodes ({count}): {items}.", "item": "{kind} at {start} s for {duration} s, {beats}, {focus}, coupling {coupling} ms", "unreliable": "Episodes not judged: {reason}."}
EPISODE_KINDS = {"ve_run": "ventricular run", "sve_run": "supraventricular run", "no_p": "stretch without P waves"}
RECORD = {"minutes": "Recorded: {pages}, {seconds} s of {minutes} min watched.", "plain": "Recorded: {pages}, {seconds} s."}
DRUGS = {"none": "No drugs named.", "given": "Drugs: {drugs}."}
FLAGS = {"manual_correction": "marks were corrected by hand", "analyze_together_forced": "sheets of several animals were taken together"}
FLAG_LIST = "Note: {items}."
PRECISION = {"known": "One pixel is {mv} mV and {ms} ms; two are {mv2} mV and {ms2} ms.", "unknown": "Precision unknown."}
IMPOSSIBLE = "No analysis: {reason}."
UNRELIABLE = "Not reliable: {items}."
VERIFY = "To be confirmed by a specialist."
TONES = {"norm": "normal", "border": "borderline", "abnormal": "deviation", "unreliable": "unreliable"}
TSV_HEADER = ("Parameter", "Value", "Range", "Verdict", "Note")
#: Problems of files, by code; {width} and {least} are filled in.
PROBLEMS = {
    "not_image": "Not an image; JPEG or PNG is needed", "pdf": "PDF is not read; save the sheet as JPEG or PNG", "corrupt": "The file is damaged or not an image",
    "too_narrow": "The image is {width} px wide; {least} px are needed", "unreadable": "The file could not be read",
}
