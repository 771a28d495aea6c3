from cellscope.functions.exprs import (
    safe_div, over_voltage, temp_flag, soc_bin, adjusted_skew, ir_health, flag_health,
    weighted_health, health_status,
)

__all__ = ["safe_div", "over_voltage", "temp_flag", "soc_bin", "adjusted_skew", "ir_health",
           "flag_health", "weighted_health", "health_status"]
