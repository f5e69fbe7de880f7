"""Tables written between jobs, in the folder that driver and executors share."""

from spindrel.plans.scratch import drop, folder, freed, new_path, save

__all__ = ["drop", "folder", "freed", "new_path", "save"]
