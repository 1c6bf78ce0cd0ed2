"""Pure column functions: geometry, risk, vessel and text parsing."""
