"""A second parameter set of the registered queries."""

from __future__ import annotations

from fiscus.sources.parameters import Parameters

# Every indicator different from every other in every year.
REVISED = Parameters.of(
    {
        "IPCA": {2020: 1.031, 2021: 1.042, 2022: 1.053, 2023: 1.064},
        "PIB": {2020: 1.011, 2021: 1.022, 2022: 1.033, 2023: 1.044},
        "EF": {2020: 1.071, 2021: 1.082, 2022: 1.093, 2023: 1.104},
        "CVFS": {2020: 1.115, 2021: 1.126, 2022: 1.137, 2023: 1.148},
        "ANFAVEA": {2020: 0.96},
        "SELIC": {2019: 0.061, 2020: 0.052, 2021: 0.043, 2022: 0.074, 2023: 0.085},
        "FX": {2019: 4.11, 2020: 4.22, 2021: 4.33, 2022: 4.44, 2023: 4.55},
        "COVID_EMPREGO": {2020: 0.91, 2021: 0.92, 2022: 0.93, 2023: 0.94},
        "INGRESSO_EXTERNO": {2020: 11000000.0, 2021: 12000000.0, 2022: 13000000.0, 2023: 14000000.0},
        "INGRESSO_INTERNO": {2020: 15000000.0, 2021: 16000000.0, 2022: 17000000.0, 2023: 18000000.0},
        "PIB_SC": {2017: 275000000000.0, 2018: 298000000000.0, 2019: 317000000000.0},
    }
)
