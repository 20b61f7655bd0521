"""Column functions: text rules, JSON of models, geometry and calibration."""
