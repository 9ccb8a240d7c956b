"""What interrupts, ports and constants of the machine stand for, and the base names that roles give."""

INTERRUPTS = {
    0x05: "BIOS print screen",
    0x08: "IRQ0 timer (hardware)",
    0x09: "IRQ1 keyboard (hardware)",
    0x10: "BIOS video",
    0x11: "BIOS equipment list",
    0x12: "BIOS memory size",
    0x13: "BIOS disk",
    0x14: "BIOS serial",
    0x15: "BIOS misc / cassette",
    0x16: "BIOS keyboard",
    0x17: "BIOS printer",
    0x1A: "BIOS time of day",
    0x1B: "Ctrl-Break handler",
    0x1C: "timer tick user hook -- the game's heartbeat",
    0x20: "DOS terminate (old)",
    0x21: "DOS services",
    0x25: "DOS absolute disk read",
    0x26: "DOS absolute disk write",
    0x27: "DOS terminate and stay resident",
    0x33: "mouse driver",
}

PORTS = {
    0x20: "PIC command (interrupt acknowledge)",
    0x21: "PIC mask",
    0x40: "PIT channel 0 -- system timer",
    0x41: "PIT channel 1",
    0x42: "PIT channel 2 -- PC speaker tone",
    0x43: "PIT control",
    0x60: "keyboard data",
    0x61: "keyboard control / speaker gate",
    0x201: "joystick",
    0x278: "parallel port",
    0x2F8: "serial COM2",
    0x388: "AdLib address",
    0x389: "AdLib data",
    0x3B4: "MDA CRTC",
    0x3BC: "parallel port",
    0x3D4: "CGA CRTC index",
    0x3D5: "CGA CRTC data",
    0x3D8: "CGA mode control",
    0x3D9: "CGA colour select",
    0x3DA: "CGA status -- vertical retrace polling",
    0x3F2: "floppy digital output",
    0x3F8: "serial COM1",
}

#: Constants below 0x100 are too common to be evidence.
CONSTANTS = {
    0xB800: "CGA / colour text video segment",
    0xB000: "MDA / Hercules video segment",
    0xA000: "EGA / VGA graphics segment",
    0x2000: "CGA odd-scanline bank offset",
    320: "screen width, mode 4/13h",
    640: "screen width, mode 6/12h",
}

ROLES = {
    "BIOS video": "bios_video",
    "BIOS keyboard": "bios_keyboard",
    "BIOS disk": "bios_disk",
    "BIOS serial": "bios_serial",
    "BIOS printer": "bios_printer",
    "BIOS time of day": "bios_time",
    "BIOS equipment list": "bios_equipment",
    "BIOS memory size": "bios_memsize",
    "BIOS print screen": "bios_printscreen",
    "DOS services": "dos_svc",
    "DOS terminate (old)": "dos_terminate",
    "mouse driver": "mouse",
    "Ctrl-Break handler": "ctrl_break_handler",
    "timer tick user hook -- the game's heartbeat": "timer_tick_handler",
    "IRQ1 keyboard (hardware)": "keyboard_isr",
    "IRQ0 timer (hardware)": "timer_isr",
    "PIC command (interrupt acknowledge)": "pic_ack",
    "PIC mask": "pic_mask",
    "PIT channel 2 -- PC speaker tone": "speaker_tone",
    "PIT control": "pit_control",
    "PIT channel 0 -- system timer": "pit_timer",
    "keyboard data": "keyboard_port",
    "keyboard control / speaker gate": "speaker_gate",
    "joystick": "joystick_read",
    "CGA mode control": "cga_mode",
    "CGA colour select": "cga_colour",
    "CGA status -- vertical retrace polling": "cga_retrace_wait",
    "CGA CRTC index": "cga_crtc",
    "CGA CRTC data": "cga_crtc",
    "AdLib address": "adlib",
    "AdLib data": "adlib",
    "CGA / colour text video segment": "cga_access",
    "EGA / VGA graphics segment": "vga_access",
    "MDA / Hercules video segment": "mda_access",
    "CGA odd-scanline bank offset": "cga_access",
    "floppy digital output": "floppy_port",
    "serial COM1": "serial_com1",
    "serial COM2": "serial_com2",
    "C runtime startup (program entry point)": "crt_startup",
    "main": "main",
}
