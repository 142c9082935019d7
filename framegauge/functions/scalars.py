"""Column functions: metrics, budgets, colours, shifts, ids and economy curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical(v: Column | str) -> Column:
    """Round up to four decimals, by the value's sixteen-place decimal and not by binary ceil."""
    return (F.ceil(_c(v).cast("decimal(20,16)") * 10000).cast("double") / 10000).cast("double")


def passes(metric: Column | str, budget: Column | str) -> Column:
    return canonical(metric) <= _c(budget)


def channels(rgb: Column | str) -> tuple[Column, Column, Column]:
    rgb = _c(rgb)
    return F.shiftright(rgb, 16), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)


def rgb_distance(a: Column | str, b: Column | str) -> Column:
    """Sum of squared channel differences."""
    return sum(((x - y) * (x - y) for x, y in zip(channels(a), channels(b), strict=True)), F.lit(0))


def luma(rgb: Column | str) -> Column:
    r, g, b = channels(rgb)
    return r * 0.299 + g * 0.587 + b * 0.114


def lab(rgb: Column | str) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of an sRGB colour."""
    lin = [F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92) for c in channels(rgb)]
    # sRGB to XYZ, and the D65 white point.
    rows = ((0.4124, 0.3576, 0.1805, 0.95047), (0.2126, 0.7152, 0.0722, 1.0), (0.0193, 0.1192, 0.9505, 1.08883))
    x, y, z = ((lin[0] * a + lin[1] * b + lin[2] * c) / w for a, b, c, w in rows)
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16.0 / 116.0)
    return f(y) * 116.0 - 16.0, (f(x) - f(y)) * 500.0, (f(y) - f(z)) * 200.0


def delta_e(a: Column | str, b: Column | str) -> Column:
    """CIE76 difference of two colours."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(lab(a), lab(b), strict=True)), F.lit(0.0)))


def chebyshev(dx: Column | str, dy: Column | str) -> Column:
    return F.greatest(F.abs(_c(dx)), F.abs(_c(dy)))


def alpha_budget(good: Column | str, control: Column | str, alpha: float = 0.5) -> Column:
    """canonical(G + alpha (C - G)) where C > G and the result stays under C, else null."""
    good, control = _c(good), _c(control)
    value = canonical(good + (control - good) * alpha)
    return F.when((control > good) & (value >= good) & (value < control) & F.lit(0 <= alpha <= 1), value)


def legacy_budget(worst: Column | str) -> Column:
    """The worst good value rounded up to two decimals, plus 0.02."""
    return (F.ceil(_c(worst).cast("decimal(20,16)") * 100).cast("double") + 2) / 100


def tristate(metric: Column | str, status: Column | str, budget: Column | str, hard_fail: Column | str) -> Column:
    """PASS up to the budget; SEPARATED gates FAIL from hard_fail; all else is REVIEW. Null without budget or status."""
    m, status = canonical(metric), _c(status)
    return (
        F.when(_c(budget).isNull() | ~status.isin("SEPARATED", "UNSEPARATED"), F.lit(None).cast("string"))
        .when(m <= _c(budget), "PASS").when((status == "SEPARATED") & (m >= _c(hard_fail)), "FAIL").otherwise("REVIEW")
    )


def review_band(outcome: Column | str, metric: Column | str, budget: Column | str, hard_fail: Column | str) -> Column:
    return F.coalesce((_c(outcome) == "REVIEW") | ((_c(metric) > _c(budget)) & (_c(metric) < _c(hard_fail))), F.lit(False))


def keyed(r: Column | str, g: Column | str, b: Column | str, a: Column | str, tolerance: int = 40) -> Column:
    """Chroma key: half transparent, or every channel within the tolerance of magenta."""
    near = (F.abs(_c(r) - 255) <= tolerance) & (F.abs(_c(g)) <= tolerance) & (F.abs(_c(b) - 255) <= tolerance)
    return (_c(a) < 128) | near


def retention(isolation: Column | str, flagged: Column | str, ordinal: Column | str) -> Column:
    keep = _c(isolation).isin("ISOLATED", "INDETERMINATE") | _c(flagged) | (_c(ordinal) <= 3)
    return F.when(keep, "retained").otherwise("discarded")


def attempt_id(motion_class: Column | str, gate: Column | str, ordinal: Column | str) -> Column:
    return F.concat_ws("--", _c(motion_class), _c(gate), F.format_string("%03d", _c(ordinal)))


def is_digest(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike("^[0-9a-f]{64}$"), F.lit(False))


def legacy_path(path: Column | str) -> Column:
    """prototype/strip-coherence at a path boundary becomes corpus/strip-coherence."""
    return F.regexp_replace(_c(path), "^prototype/strip-coherence(?=/|$)", "corpus/strip-coherence")


def hardness(n: Column | str) -> Column:
    return F.pow(F.lit(1.15), _c(n)) * 1000.0


def dig_rate(owned: Column | str) -> Column:
    return _c(owned) * 0.25 + 1.0


def smelt_rate(owned: Column | str) -> Column:
    return F.pow(F.lit(1.5), _c(owned)) * 0.06


def upgrade_cost(owned: Column | str, hire: Column | str) -> Column:
    return F.when(_c(hire), F.lit(160.0)).otherwise(F.pow(F.lit(2.0), _c(owned)) * 5.0)


def offline_window(now_ms: Column | str, saved_ms: Column | str, most_ms: float = 8 * 3600 * 1000.0) -> Column:
    """Milliseconds away, between 0 and eight hours; 0 without a finite saving time."""
    saved = F.when(F.isnan(_c(saved_ms)) | (F.abs(_c(saved_ms)) == float("inf")), None).otherwise(_c(saved_ms))
    return F.when(saved.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(_c(now_ms) - saved, F.lit(most_ms))))


def damage_bucket(x: Column | str) -> Column:
    x = _c(x)
    return F.when((x < 0) | (x > 1), None).when(x < 0.25, "intact").when(x < 0.5, "chipped").when(x < 0.75, "cracked").otherwise("crumbling")


def unload_ms(owned: Column | str) -> Column:
    return F.lit(4000.0) / (_c(owned) * 0.5 + 1.0)


def trip_leg(left_ms: Column | str, owned: Column | str) -> Column:
    """Leg of a haul (out, unload, back) whose countdown stands at left_ms; null at 0."""
    left = _c(left_ms)
    return F.when(left == 0, None).when(left > unload_ms(owned) + 2000.0, "out").when(left > 2000.0, "unload").otherwise("back")


def trip_progress(left_ms: Column | str, owned: Column | str) -> Column:
    return F.when(_c(left_ms) != 0, F.lit(1.0) - _c(left_ms) / (unload_ms(owned) + 4000.0))
