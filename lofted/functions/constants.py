"""Physical constants and standard tables."""

# Units, WGS-84, the US Standard Atmosphere 1976 and the lifting gases.
STANDARD_GRAVITY = 9.80665
GAS_CONSTANT = 8.31432
CELSIUS_ZERO_K = 273.15
LENGTH_M = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "nmi": 1852.0, "mi": 1609.344}
MASS_KG = {"kg": 1.0, "g": 0.001, "lb": 0.45359237}
PRESSURE_PA = {"Pa": 1.0, "hPa": 100.0, "mbar": 100.0, "kPa": 1000.0}
KNOT_MS = 1852.0 / 3600.0
SEMI_MAJOR_M = 6378137.0
INVERSE_FLATTENING = 298.257223563
EARTH_RADIUS_M = (2 * SEMI_MAJOR_M + SEMI_MAJOR_M * (1 - 1 / INVERSE_FLATTENING)) / 3
POTENTIAL_RADIUS_M = 6_356_766.0
MOLAR_MASS_AIR = 28.9644e-3
SEA_LEVEL_PA = 101_325.0
GAMMA = 1.4
FLOOR_M, CEILING_M = -5_000.0, 86_000.0
#: (base geopotential height m, base temperature K, lapse K/m)
LAYERS = ((0.0, 288.15, -0.0065), (11_000.0, 216.65, 0.0), (20_000.0, 216.65, 0.001), (32_000.0, 228.65, 0.0028), (47_000.0, 270.65, 0.0), (51_000.0, 270.65, -0.0028), (71_000.0, 214.65, -0.002), (84_852.0, 186.946, 0.0))
GAS_MOLAR_MASS = {"HELIUM": 4.002602e-3, "HYDROGEN": 2.01588e-3}
AIR_CONSTANT = GAS_CONSTANT / MOLAR_MASS_AIR
