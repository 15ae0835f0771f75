"""DataFrame operators: term counts, lexicons, scores, rules, bands, calibration."""
