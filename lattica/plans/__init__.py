"""From a formula to a result: binding and the estimation plan."""
