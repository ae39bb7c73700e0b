"""Named plans, shared values, kept frames, and the registered queries."""
