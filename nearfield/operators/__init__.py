"""nearfield package."""
