"""Nearest-neighbour thermodynamics of primers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The unified nearest-neighbour parameters of SantaLucia (1998),
# as enthalpy (kcal/mol), entropy (cal/K/mol) and Gibbs energy at 37 degrees C (kcal/mol).
PAIRS = {
    "AA": (-7.6, -21.3, -1.00),
    "AT": (-7.2, -20.4, -0.88),
    "TA": (-7.2, -21.3, -0.58),
    "CA": (-8.5, -22.7, -1.45),
    "GT": (-8.4, -22.4, -1.44),
    "CT": (-7.8, -21.0, -1.28),
    "GA": (-8.2, -22.2, -1.30),
    "CG": (-10.6, -27.2, -2.17),
    "GC": (-9.8, -24.4, -2.24),
    "GG": (-8.0, -19.9, -1.84),
}
INITIATION = (0.2, -5.7, 1.96)
TERMINAL_AT = (2.2, 6.9, 0.05)
GAS_CONSTANT = 1.9872041  # cal/K/mol
KELVIN = 273.15
JOULE = 4.1868


def closed_pairs() -> dict[str, tuple[float, float, float]]:
    """The table with the reading of each pair on the other strand."""
    other = str.maketrans("ACGT", "TGCA")
    return PAIRS | {k[::-1].translate(other): v for k, v in PAIRS.items()}


def table_sum(primer: Column, which: int) -> Column:
    """Initiation, the pairs' values and those of terminal A or T; ``which``: 0 enthalpy, 1 entropy, 2 Gibbs energy.

    Each of the sixteen pairs is counted by a pattern that looks ahead, so the string is never cut up.
    """
    total = F.lit(INITIATION[which])
    for pair, values in sorted(closed_pairs().items()):
        total = total + F.regexp_count(primer, F.lit(f"{pair[0]}(?={pair[1]})")) * F.lit(values[which])
    ends = F.substr(primer, F.lit(1), F.lit(1)).isin("A", "T").cast("int") + F.substr(primer, F.lit(-1), F.lit(1)).isin("A", "T").cast("int")
    return total + ends * F.lit(TERMINAL_AT[which])


def enthalpy(primer: Column) -> Column:
    return table_sum(primer, 0)


def entropy(primer: Column) -> Column:
    return table_sum(primer, 1)


def gibbs(primer: Column, celsius: float = 37.0) -> Column:
    """From the table at 37 degrees C, otherwise enthalpy less temperature times entropy."""
    if abs(celsius - 37.0) < 1e-6:
        return table_sum(primer, 2)
    return enthalpy(primer) - (celsius + KELVIN) * entropy(primer) / 1000.0


def dissociation(gibbs_energy: Column, celsius: float) -> Column:
    """Dissociation constant."""
    return F.exp(-1000.0 * gibbs_energy / ((celsius + KELVIN) * GAS_CONSTANT))


def fraction_bound(concentration: Column, constant: Column) -> Column:
    return concentration / (concentration + constant)


def report(primer: Column, concentration: Column, celsius: float = 37.0) -> Column:
    """``struct<enthalpy, entropy, gibbs, dissociation, bound>`` of a primer at a temperature and concentration."""
    energy = gibbs(primer, celsius)
    constant = dissociation(energy, celsius)
    return F.struct(enthalpy(primer).alias("enthalpy"), entropy(primer).alias("entropy"), energy.alias("gibbs"), constant.alias("dissociation"), fraction_bound(concentration, constant).alias("bound"))
