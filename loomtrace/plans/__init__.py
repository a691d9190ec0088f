"""Models and kernels that are fanned out over tables of runs."""
