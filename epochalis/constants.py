"""Fixed values of the domain."""

#: fixed values: half-open frequency bands in Hz
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 40.0)}
#: fixed values: what counts as an oscillation
MIN_CYCLES, OSC_LOW, OSC_HIGH = 0.5, 0.5, 40.0
#: fixed values: the signal gate (milliseconds, converter rails, share at the rails, deviations)
SPAN_MS, RAILS, RAIL_SHARE, MAX_ABS_Z, FLAT = (1500.0, 2200.0), (0.0, 1649.0), 0.01, 8.0, 1e-3
#: fixed values: two atoms are simultaneous, or one rhythm, within these
COINCIDENCE_S, FREQ_TOL_HZ = 0.25, 2.0
ENERGY_FLOOR = 1e-12
