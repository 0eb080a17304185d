"""Plans of many operators: registration of pairs of images."""
