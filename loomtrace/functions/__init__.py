"""Column functions: state maps, markings, guards and conditions."""
