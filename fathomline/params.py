"""Parameters of the engine, with the defaults that results depend on (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    service_speed_kn: float = 14.0
    km_per_nm: float = 1.852
    fuel_t_per_day: float = 35.0
    fuel_usd_t: float = 600.0
    time_usd_h: float = 2000.0
    risk_usd: float = 300.0
    risk_free: float = 0.20
    risk_power: float = 2.0
    wave_limit_m: float = 6.0
    wind_limit_kmh: float = 75.0
    current_limit_kmh: float = 8.0
    no_go_factor: float = 50.0
    safety_from: float = 0.25
    safety_factor: float = 10.0
    turn_cap_deg: float = 165.0
    horizon_h: int = 72
    idw_neighbours: int = 6
    impute_neighbours: int = 4
    rounds: int = 3
    #: pixels a side
    vector_grid: int = 72
    severity_grid: int = 180
    risk_raster: int = 512
    #: degrees
    severity_pad: float = 0.12
    wind_pad: float = 0.5
    wind_step: float = 0.25
    splat_deg: float = 1.25
    raster_pad: float = 1.0
    converged: float = 0.01
    co2_factor: float = 3.114
    attach_km: float = 35.0
    hex_link_km: float = 65.0
    hex_spacing_deg: float = 0.30
    hex_max_points: int = 2200
    connector_km: float = 4.0
    #: alpha (time), beta (risk), gamma (fuel) of each objective
    profiles: dict[str, tuple[float, float, float]] = field(default_factory=lambda: {"balanced": (1.0, 0.45, 1.0), "safety": (0.7, 1.5, 1.0), "distance": (1.0, 0.0, 0.0)})
    pareto: dict[str, tuple[float, float, float]] = field(default_factory=lambda: {"fastest": (1.0, 0.0, 0.0), "safest": (0.0, 1.0, 0.0), "efficient": (0.0, 0.0, 1.0)})
    defaults: dict[str, float] = field(default_factory=lambda: {
        "wind_speed": 10.0, "wind_dir": 180.0, "precipitation": 0.0, "visibility": 10000.0, "wave_height": 1.0, "wave_dir": 180.0, "current_vel": 0.5, "current_dir": 180.0})

    @property
    def km_per_hour(self) -> float:
        return self.service_speed_kn * self.km_per_nm


DEFAULT = Params()
