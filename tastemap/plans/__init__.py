"""Query catalogue (one entry per inventory capability) and jobs."""
