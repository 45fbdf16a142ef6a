"""PDF dates, told by their shape: every digit is a 9, and only some shapes are dates."""

from __future__ import annotations

from datetime import datetime

#: Digits of year, month, day, hour, minute and second that may stand after `D:`, and the zones after them.
DIGITS = (4, 6, 8, 10, 12, 14)
ZONES = ("", "Z", *(f"{sign}99{minutes}" for sign in "+-" for minutes in ("", "99", "'99", "99'", "'99'")))
#: The number of digits by shape.
SHAPES = {f"D:{'9' * n}{zone}": n for n in DIGITS for zone in ZONES}
NINES = str.maketrans("0123456789", "9" * 10)


def iso_date(value: str) -> str:
    """A PDF date in ISO form; a missing zone stays missing, what is no valid date stays as it is."""
    n = SHAPES.get(value.translate(NINES))
    if n is None:
        return value
    digits, zone = value[2 : 2 + n], value[2 + n :].replace("'", "")
    digits += "00000101000000"[n:]
    try:
        when = datetime.strptime(digits, "%Y%m%d%H%M%S") if digits[12:] < "60" else None
    except ValueError:
        return value
    hours, minutes = zone[1:3] or "00", zone[3:] or "00"
    if when is None or hours > "23" or minutes > "59":
        return value
    shown = "" if not zone else "+00:00" if zone == "Z" else f"{zone[0]}{hours}:{minutes}"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}{shown}"
